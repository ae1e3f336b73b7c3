"""Resume fragments of at most so many words, along paragraphs and sentences: one fold over a text's units, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions import columns as C

MAX_WORDS = 300
UNIT = "array<struct<kind:string,n:int,text:string>>"
STATE = "struct<out:array<string>,lines:string,stops:string,size:int,open:boolean>"


def _units(text: Column, most: int) -> Column:
    """P: a paragraph that fits. B, then S for each of its sentences: one that is too long."""
    named = lambda kind, words, text: F.struct(F.lit(kind).alias("kind"), words.alias("n"), text.alias("text"))
    full = lambda parts: F.filter(F.transform(parts, C.strip), lambda x: x != "")
    sentences = lambda p: full(F.split(F.replace(F.replace(p, F.lit("! "), F.lit(". ")), F.lit("? "), F.lit(". ")), r"\. "))
    counted = F.transform(full(F.split(F.coalesce(text, F.lit("")), "\n")), lambda p: F.struct(C.word_count(p).alias("n"), p.alias("p")))
    long = lambda x: F.concat(F.array(named("B", F.lit(0), F.lit(""))).cast(UNIT), F.transform(sentences(x["p"]), lambda s: named("S", C.word_count(s), s)).cast(UNIT))
    return F.flatten(F.transform(counted, lambda x: F.when(x["n"] > most, long(x)).otherwise(F.array(named("P", x["n"], x["p"])).cast(UNIT))))


def chunks(text: Column, most: int = MAX_WORDS) -> Column:
    """The fragments of a text; none where it has no words.

    Paragraphs are packed while they fit. One that is too long is cut into sentences, packed likewise and closed by a full stop; the
    sentences left over stay open and the next paragraphs join them by line. A sentence that is too long stays whole.
    """

    def step(s: Column, u: Column) -> Column:
        full = (u["kind"] == "B") | (s["size"] + u["n"] > most)
        closed = F.when(u["kind"] == "S", F.concat(s["stops"], F.lit("."))).otherwise(s["lines"])
        fresh = full | ~s["open"]
        joined = lambda name, mark: F.when(fresh, u["text"]).otherwise(F.concat(s[name], F.lit(mark), u["text"])).alias(name)
        return F.struct(
            F.when(full & s["open"], F.concat(s["out"], F.array(closed))).otherwise(s["out"]).alias("out"), joined("lines", "\n"), joined("stops", ". "),
            F.when(full, u["n"]).otherwise(s["size"] + u["n"]).alias("size"), (u["kind"] != "B").alias("open"),
        ).cast(STATE)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("lines"), F.lit("").alias("stops"), F.lit(0).alias("size"), F.lit(False).alias("open")).cast(STATE)
    return F.aggregate(_units(text, most), start, step, lambda s: F.when(s["open"], F.concat(s["out"], F.array(s["lines"]))).otherwise(s["out"]))


def fragments(pool: DataFrame, key: str = "candidate_id", text: str = "resume_text") -> DataFrame:
    """(key, frag_no, fragment); a text without words has one empty fragment."""
    cut = pool.select(key, chunks(F.col(text)).alias("c"))
    return cut.select(key, F.posexplode(F.when(F.size("c") > 0, F.col("c")).otherwise(F.array(F.lit("")))).alias("frag_no", "fragment"))
