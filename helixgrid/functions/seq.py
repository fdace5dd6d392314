"""Column functions over sequences, qualities and alignment strings. All are built-in expressions, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRED_ZERO = 33


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base4(number: Column | str, length: int) -> Column:
    """Digits of a number in base 4 as bases (A < C < G < T), zero-padded to `length`."""
    return F.translate(F.lpad(F.conv(_c(number).cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def revcomp(seq: Column | str, any_case: bool = True) -> Column:
    """Reverse complement. `any_case`: lower-case bases are complemented to upper-case ones, else left as they are."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCATGCA") if any_case else F.translate(_c(seq), "ACGT", "TGCA"))


def complement_keeping_case(seq: Column | str) -> Column:
    return F.translate(_c(seq), "ACGTacgt", "TGCAtgca")


def error_probability(quality: Column) -> Column:
    """Of a Phred score given as a number, offset included."""
    return F.pow(F.lit(10.0), -(quality - PHRED_ZERO) / F.lit(10.0))


def chars(text: Column | str) -> Column:
    """Array of the characters of a text; empty for an empty one."""
    return F.filter(F.split(_c(text), ""), lambda x: x != "")


def expected_errors(qual: Column | str) -> Column:
    """Sum of the error probabilities of a quality string."""
    return F.aggregate(chars(qual), F.lit(0.0), lambda a, q: a + error_probability(F.ascii(q)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of places in which two texts of one length differ; null for different lengths."""
    diff = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, d: s + d)
    return F.when(F.length(_c(a)) == F.length(_c(b)), diff)


def hamming_fixed(a: Column, b: Column, length: int) -> Column:
    """Hamming distance of texts of a known length, as a sum that stays within generated code."""
    out = F.lit(0)
    for i in range(1, length + 1):
        out = out + F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0)
    return out


def best_match(text: Column | str, pattern: str) -> Column:
    """struct(pos, mismatches) of the leftmost window with the fewest mismatches; pos is 0-based, null where the text is
    shorter than the pattern, or where a pattern of one character isn't found (then 1 mismatch)."""
    m, t = len(pattern), _c(text)
    miss = lambda i: sum((F.when(F.substr(t, i + k + 1, F.lit(1)) != F.lit(ch), 1).otherwise(0) for k, ch in enumerate(pattern)), F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), F.length(t) - m), lambda i: F.struct(miss(i).alias("mismatches"), i.alias("pos")))
    found = F.when(F.length(t) >= m, F.array_min(windows))
    nowhere = (F.length(t) < m) | (found["mismatches"] == m) if m == 1 else F.length(t) < m
    exact = F.instr(t, F.lit(pattern))
    out = lambda pos, n: F.struct(pos.cast("int").alias("pos"), n.cast("int").alias("mismatches"))
    return F.when(exact > 0, out(exact - 1, F.lit(0))).when(nowhere, out(F.lit(None), F.lit(m))).otherwise(out(found["pos"], found["mismatches"]))


def strip_mate_suffix(name: Column | str) -> Column:
    """Removes a closing /1 or /2 from names of more than two characters."""
    return F.regexp_replace(_c(name), r"(?<=.)/[12]$", "")


def q30_bases(qual: Column | str) -> Column:
    """Number of qualities of at least 30."""
    return F.length(F.regexp_replace(_c(qual), r"[^?-~]", ""))


def poly_prefix(seq: Column | str, base: str) -> Column:
    """Length of the best homopolymer run at the start of a sequence, errors allowed: matches score 1, others -2, and at
    most a fifth of the prefix may differ; null if no prefix scores above 0. For the 3' end pass the reversed text."""
    step = lambda s, i: F.when(F.substr(_c(seq), i, F.lit(1)) == base, 1).otherwise(0)

    def walk(s: Column, i: Column) -> Column:
        hit = step(s, i)
        score, errors = s["score"] + F.when(hit == 1, 1).otherwise(-2), s["errors"] + (1 - hit)
        better = (score > s["top"]) & (5 * errors <= i)
        return F.struct(score.alias("score"), errors.alias("errors"), F.when(better, score).otherwise(s["top"]).alias("top"), F.when(better, i).otherwise(s["at"]).alias("at"))

    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("errors"), F.lit(0).alias("top"), F.lit(0).alias("at"))
    places = F.when(F.length(_c(seq)) > 0, F.sequence(F.lit(1), F.length(_c(seq)))).otherwise(F.array().cast("array<int>"))
    at = F.aggregate(places, zero, walk, lambda s: s["at"])
    return F.when(at > 0, at)


def _clip(cigar: Column, pattern: str) -> Column:
    lengths = F.regexp_extract_all(F.regexp_extract(cigar, pattern, 1), F.lit(r"(\d+)[SH]"), 1)
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def clip_before(cigar: Column | str) -> Column:
    """Clipped bases in front of the aligned part."""
    return _clip(_c(cigar), r"^((?:\d+[SH])+)")


def clip_after(cigar: Column | str) -> Column:
    """Clipped bases behind the aligned part; 0 for an alignment that is clipped as a whole."""
    return F.when(_c(cigar).rlike(r"^(?:\d+[SH])+$"), F.lit(0).cast("long")).otherwise(_clip(_c(cigar), r"((?:\d+[SH])+)$"))


def reference_length(cigar: Column | str) -> Column:
    """Reference bases that an alignment spans."""
    lengths = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def spliced_segments(pos: Column | str, cigar: Column | str) -> Column:
    """Reference segments (start, end) of an alignment, 0-based and half-open, cut at skipped regions. `pos` is 1-based.
    M, D, = and X advance; I, S and H do not."""
    ops = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+[MDNX=])"), 1)
    start = (_c(pos) - 1).cast("long")

    def walk(s: Column, op: Column) -> Column:
        n, skip = F.regexp_extract(op, r"^(\d+)", 1).cast("long"), op.endswith("N")
        done = F.when(skip & (s["end"] > s["start"]), F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])
        return F.struct(F.when(skip, s["end"] + n).otherwise(s["start"]).alias("start"), (s["end"] + n).alias("end"), done.alias("out"))

    zero = F.struct(start.alias("start"), start.alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    last = lambda s: F.when(s["end"] > s["start"], F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])
    return F.aggregate(ops, zero, walk, last)


def md_tokens(md: Column | str) -> Column:
    """Tokens of an MD tag: numbers, bases and ^deletions."""
    return F.regexp_extract_all(_c(md), F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), 1)


def mutation_name(kind: Column | str, length: Column | str, bases: Column | str) -> Column:
    """Short name of a mutation: the base, D and a length, or I and the bases."""
    k = _c(kind)
    return F.when(k == "sub", _c(bases)).when(k == "del", F.concat(F.lit("D"), _c(length).cast("string"))).when(k == "ins", F.concat(F.lit("I"), _c(bases)))


def mutation_query_length(kind: Column | str, length: Column | str) -> Column:
    return F.when(_c(kind) == "del", 0).otherwise(_c(length))


def mutation_reference_length(kind: Column | str, length: Column | str) -> Column:
    return F.when(_c(kind) == "ins", 0).otherwise(_c(length))


def empty_drops_range(chemistry: Column | str, chips: Column | str) -> Column:
    """struct(first, last) rank of the barcodes taken for empty droplets, by chemistry and number of chips."""
    c, n = _c(chemistry), _c(chips)
    top = F.when(c == "v3LT", F.lit(9000)).when(c == "v4", F.when(n.isNull(), F.lit(160000)).otherwise(80000 * n)).otherwise(F.when(n.isNull(), F.lit(90000)).otherwise(45000 * n))
    return F.struct((top / 2).cast("long").alias("first"), top.cast("long").alias("last"))


def exons_valid(exons: Column | str) -> Column:
    """Whether exons are sorted, do not overlap and are not empty."""
    e = _c(exons)
    later = F.forall(F.transform(e, lambda x, i: F.coalesce(F.get(e, i + 1)["start"] >= x["end"], F.lit(True))), lambda x: x)
    return F.forall(e, lambda x: x["end"] > x["start"]) & later


def exonic_length(exons: Column | str) -> Column:
    return F.aggregate(_c(exons), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def transcript_offset(exons: Column | str, position: Column | str) -> Column:
    """Place of a genome position within the spliced transcript; null outside of its exons."""
    p = _c(position)
    inside = F.exists(_c(exons), lambda x: (x["start"] <= p) & (p < x["end"]))
    return F.when(inside, F.aggregate(_c(exons), F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.least(x["end"], p) - x["start"], F.lit(0).cast("long"))))


def five_prime(start: Column | str, end: Column | str, flags: Column | str) -> Column:
    """The 5' end of an alignment: its end if it is on the reverse strand, else its start."""
    return F.when(_c(flags).bitwiseAND(16) != 0, _c(end)).otherwise(_c(start))
