"""Variants of single reads, from their CIGAR and MD texts, as built-in expressions.

Both texts become runs on one axis, that of the reference bases which CIGAR and MD describe alike. A substitution of MD is
looked up in the aligned run that covers its place; deletions must be the same runs in both; insertions are in CIGAR alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import md_tokens, reference_length

#: Least base quality (without offset) of a substitution, and of the first base of an insertion.
LEAST_QUALITY = 30
_RUN = "array<struct<i:int,kind:string,n:bigint,axis:bigint,read:bigint>>"


def _runs(tokens: Column, kind, length, on_axis, in_read) -> Column:
    """Array of (i, kind, n, axis, read): every token with its length and where it begins on the axis and in the read."""

    def step(s: Column, t: Column) -> Column:
        k, n = kind(t), length(t)
        here = F.struct(F.size(s["out"]).alias("i"), k.alias("kind"), n.alias("n"), s["axis"].alias("axis"), s["read"].alias("read"))
        move = lambda yes: F.when(yes, n).otherwise(F.lit(0).cast("long"))
        return F.struct((s["axis"] + move(on_axis(k))).alias("axis"), (s["read"] + move(in_read(k))).alias("read"), F.concat(s["out"], F.array(here)).alias("out"))

    zero = F.lit(0).cast("long")
    return F.aggregate(tokens, F.struct(zero.alias("axis"), zero.alias("read"), F.array().cast(_RUN).alias("out")), step)


def cigar_runs(cigar: Column | str) -> Column:
    """struct(axis, read, out): total lengths and runs of a CIGAR text. M, X and D lie on the axis; M, X, "=", I and S in the
    read. Skipped regions and "=" do not move the axis, both as defined for parity."""
    ops = F.regexp_extract_all(F.col(cigar) if isinstance(cigar, str) else cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return _runs(ops, lambda t: F.right(t, F.lit(1)), lambda t: F.regexp_extract(t, r"^(\d+)", 1).cast("long"), lambda k: k.isin("M", "X", "D"), lambda k: k.isin("M", "X", "=", "I", "S"))


def md_runs(md: Column | str) -> Column:
    """struct(axis, read, out): total length and runs of an MD text, of kind same, sub or del."""
    deleted, number = (lambda t: t.startswith("^")), (lambda t: t.rlike(r"^\d"))
    kind = lambda t: F.when(deleted(t), "del").when(number(t), "same").otherwise("sub")
    length = lambda t: F.when(deleted(t), F.length(t) - 1).when(number(t), t.cast("long")).otherwise(1).cast("long")
    return _runs(md_tokens(md), kind, length, lambda k: F.lit(True), lambda k: F.lit(False))


def _found(cigar: Column, md: Column) -> Column:
    """All variants (i, axis, kind, n, read), in the order of the read."""
    as_kind = lambda name: lambda r: F.struct(r["i"].alias("i"), r["axis"].alias("axis"), F.lit(name).alias("kind"), r["n"].alias("n"), r["read"].alias("read"))

    def substitutions(op: Column) -> Column:
        inside = F.filter(md, lambda t: (t["kind"] == "sub") & (t["axis"] >= op["axis"]) & (t["axis"] < op["axis"] + op["n"]))
        return F.transform(inside, lambda t: F.struct(op["i"].alias("i"), t["axis"].alias("axis"), F.lit("sub").alias("kind"), t["n"].alias("n"), (op["read"] + t["axis"] - op["axis"]).alias("read")))

    of = lambda *kinds: F.filter(cigar, lambda r: r["kind"].isin(*kinds))
    return F.array_sort(F.concat(F.flatten(F.transform(of("M", "X"), substitutions)), F.transform(of("D"), as_kind("del")), F.transform(of("I"), as_kind("ins"))))


def render_variants(variants: Column, length: Column) -> Column:
    """struct(done, text): text of the variants (axis, kind, n, bases) of a read that spans `length` bases: matches as
    numbers, bases, ^ and dashes, + and bases. done is null if a variant lies before the end of the one before it."""

    def step(s: Column, v: Column) -> Column:
        shown = F.when(v["kind"] == "sub", v["bases"]).when(v["kind"] == "del", F.concat(F.lit("^"), F.repeat(F.lit("-"), v["n"].cast("int")))).otherwise(F.concat(F.lit("+"), v["bases"]))
        done = F.when(v["axis"] >= s["done"], v["axis"] + F.when(v["kind"] == "ins", 0).otherwise(v["n"]))
        return F.struct(done.alias("done"), F.concat(s["text"], (v["axis"] - s["done"]).cast("string"), shown).alias("text"))

    last = F.aggregate(variants, F.struct(F.lit(0).cast("long").alias("done"), F.lit("").alias("text")), step)
    return F.struct(last["done"].alias("done"), F.concat(last["text"], F.when((last["done"] < length) | (F.size(variants) == 0), (length - last["done"]).cast("string")).otherwise("")).alias("text"))


def call_variants(alignments: DataFrame, *keys: str) -> DataFrame:
    """keys (name, if none is given), snvs (array of position, kind, length, bases; kind sub, del or ins, positions 0-based in the reference), text and
    error of alignments with pos (1-based), cigar, md, seq and qual (text). A row whose texts do not fit each other, or that
    has a null among these, has null results and says why in error. A step for each run of a read, and a copy of the runs
    before it, which suits the few runs of short reads."""
    keys = keys or ("name",)
    x = alignments.withColumns({"_n": reference_length("cigar"), "_c": cigar_runs("cigar"), "_m": md_runs("md")})
    x = x.withColumn("_v", _found(F.col("_c.out"), F.col("_m.out")))
    base = lambda r: F.ascii(F.substr("qual", (r["read"] + 1).cast("int"), F.lit(1))) - 33
    good = F.filter("_v", lambda v: (v["kind"] == "del") | (base(v) >= LEAST_QUALITY))
    bases = lambda v: F.when(v["kind"] == "del", "").otherwise(F.substr("seq", (v["read"] + 1).cast("int"), v["n"].cast("int")))
    x = x.withColumn("_k", F.transform(good, lambda v: F.struct(v["axis"].alias("axis"), v["kind"].alias("kind"), v["n"].alias("n"), bases(v).alias("bases"))))
    x = x.withColumn("_t", render_variants(F.col("_k"), F.col("_n")))
    gaps = lambda runs, kind: F.transform(F.filter(runs, lambda r: (r["kind"] == kind) & (r["axis"] < F.col("_c.axis"))), lambda r: F.struct(r["axis"].alias("axis"), r["n"].alias("n")))
    short = F.exists("_v", lambda v: (v["kind"] != "del") & (v["read"] >= F.least(F.length("seq"), F.length("qual"))))
    error = (
        F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in ("pos", "cigar", "md", "seq", "qual"))) == 1, "missing field")
        .when(F.col("_m.axis") < F.col("_c.axis"), F.concat(F.lit("MD "), "md", F.lit(" is shorter than CIGAR "), "cigar"))
        .when(gaps(F.col("_c.out"), "D") != gaps(F.col("_m.out"), "del"), F.concat(F.lit("deletions of MD "), "md", F.lit(" are not those of CIGAR "), "cigar"))
        .when(short, "alignment is longer than the read")
        .when(F.col("_t.done").isNull(), "a variant lies before the end of another")
        .when(F.col("_t.done") > F.col("_n"), "a variant ends behind the read's end")
    )
    snvs = F.transform("_k", lambda v: F.struct((F.col("pos").cast("long") - 1 + v["axis"]).alias("position"), v["kind"].alias("kind"), v["n"].cast("int").alias("length"), v["bases"].alias("bases")))
    out, ok = x.withColumn("_e", error), F.col("_e").isNull()
    return out.select(*keys, F.when(ok, snvs).alias("snvs"), F.when(ok, F.col("_t.text")).alias("text"), F.col("_e").alias("error"))
