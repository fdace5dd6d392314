"""FASTQ as DataFrames: scans of plain or compressed files of any size, lockstep scans, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import strip_mate_suffix
from .containers import RANGE_BYTES
from .fastq_scan import index, scan, scan_together


def _fields(head: str, seq: str, plus: str, qual: str, size: str, max_len: int, min_len: int) -> dict[str, Column]:
    """Columns of a record's lines; a record that is none, or takes fewer bytes than `min_len`, fails."""
    h, s, p, q = F.col(head), F.col(seq), F.col(plus), F.col(qual)
    bad = ~h.startswith("@") | ~p.startswith("+") | (F.length(s) != F.length(q))
    cut = (lambda c: F.substring(c, 1, max_len)) if max_len > 0 else (lambda c: c)
    fail = lambda text: F.raise_error(F.concat(F.lit(text), h)).cast("string")
    checked = F.when(bad, fail("broken record: "))
    if min_len > 0:
        checked = checked.when(F.col(size) < min_len, fail("a record takes fewer bytes than min_len: "))
    title = F.substring(h, 2, 1 << 30)
    return {
        "name": F.substring_index(title, " ", 1),
        "descr": F.when(F.instr(title, " ") > 0, F.expr(f"substring({head}, instr({head}, ' ') + 1)")).otherwise(""),
        "seq": checked.otherwise(cut(s)),
        "qual": cut(q),
    }


def read_fastq(spark: SparkSession, paths: list[str] | str, max_len: int = 0, min_len: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_idx, rec_idx (from 0 over all files, in their order), name, descr, seq, qual of FASTQ files.

    Files are plain, gzip (of one or many members, BGZF too) or zstd (of one or many frames), told by their first bytes.
    Tasks read ranges of about `range_bytes`: a range owns the records that begin in it, or in the members that begin in it,
    so that a file of a single member is streamed by one task. A first pass counts records, the scan is one more and has no
    shuffle. Sequences are cut at `max_len` if it is above 0, and a record whose four lines take fewer bytes than `min_len`
    fails. Files keep the order in which they are given, and a file given twice is read as two; a folder stands for its
    files, a pattern for those it matches; no file gives an empty table. Paths are local ones and those that Arrow's file
    systems open (hdfs, s3, gs, abfs).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    ranges = index(spark, paths, range_bytes) if paths else []
    if not any(r.n for r in ranges):
        return spark.createDataFrame([], "file_idx int, rec_idx long, name string, descr string, seq string, qual string")
    return scan(spark, ranges).select("file_idx", "rec_idx", *[c.alias(k) for k, c in _fields("head", "seq", "plus", "qual", "size", max_len, min_len).items()])


def _agreed(names: list[Column]) -> Column:
    """The name that reads share; others than equal ones fail."""
    agree = F.lit(True)
    for n in names:
        agree = agree & F.coalesce(n == names[0], F.lit(False))
    return F.when(agree, names[0]).otherwise(F.raise_error(F.concat(F.lit("reads do not belong together at record "), F.col("rec_idx").cast("string"))).cast("string"))


def read_lockstep(spark: SparkSession, paths: dict[str, list[str]], max_len: dict[str, int] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Reads that belong together, straight from their files: rec_idx, name and for each read id a struct (seq, qual), as
    `lockstep` gives them, without a shuffle. A task reads one stretch of record numbers of all files, each from the range
    that holds its first one. Files with unequal numbers of records, or names that differ, fail."""
    ranges = {k: index(spark, p, range_bytes) for k, p in paths.items()}
    if not any(r.n for x in ranges.values() for r in x):
        return spark.createDataFrame([], "rec_idx long, name string, " + ", ".join(f"`{k}` struct<seq:string,qual:string>" for k in paths))
    rows, fields = scan_together(spark, ranges), {}
    for k in paths:
        fields[k] = _fields(*[f"`{k}`.{c}" for c in ("head", "seq", "plus", "qual", "size")], (max_len or {}).get(k, 0), 0)
    name = _agreed([strip_mate_suffix(f["name"]) for f in fields.values()])
    return rows.select("rec_idx", name.alias("name"), *[F.struct(f["seq"].alias("seq"), f["qual"].alias("qual")).alias(k) for k, f in fields.items()])


def lockstep(reads: dict[str, DataFrame]) -> DataFrame:
    """The same for reads that are tables already, met by record number: a shuffle of each."""
    out: DataFrame | None = None
    for k, df in reads.items():
        one = df.select("rec_idx", strip_mate_suffix("name").alias(f"_n_{k}"), F.struct("seq", "qual").alias(k))
        out = one if out is None else out.join(one, "rec_idx", "full")
    return out.select("rec_idx", _agreed([F.col(f"_n_{k}") for k in reads]).alias("name"), *reads)


def concat_assays(*reads: DataFrame) -> DataFrame:
    """Several assays' annotated reads one after the other, with assay_idx. Their columns, and so whether they are paired,
    must agree."""
    if len({tuple(sorted(x.columns)) for x in reads}) > 1:
        raise ValueError("assays differ in their columns")
    out = reads[0].withColumn("assay_idx", F.lit(0))
    for i, x in enumerate(reads[1:], 1):
        out = out.unionByName(x.withColumn("assay_idx", F.lit(i)))
    return out


def read_onlist(spark: SparkSession, path: str) -> DataFrame:
    """barcode: the distinct lines of a list, plain or compressed."""
    return spark.read.text(path).select(F.trim("value").alias("barcode")).where("barcode <> ''").distinct()


def fastq_record(name: Column | str, seq: Column | str, qual: Column | str | None = None) -> Column:
    """A record's four lines; without qualities every base has the highest, "~"."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    q = F.regexp_replace(c(seq), ".", "~") if qual is None else c(qual)
    return F.concat(F.lit("@"), c(name), F.lit("\n"), c(seq), F.lit("\n+\n"), q)


def write_fastq(reads: DataFrame, path: str, name: str = "name", seq: str = "seq", qual: str | None = "qual", compression: str = "gzip", order: str | None = "rec_idx") -> None:
    """A folder of FASTQ files; ordered over all files by `order`. Compression: none, gzip, or another codec that Spark's
    text writer has."""
    kept = reads.orderBy(order) if order else reads
    kept.select(fastq_record(name, seq, qual).alias("value")).write.option("compression", compression).text(path)


def consolidated(reads: DataFrame, corrected: bool = False) -> DataFrame:
    """One record for each annotated read: barcode (the corrected one, if wanted; reads without it go) and UMI in front of
    the first read, whose name and second read stay. `reads`: name, barcode, barcode_qual, corrected, umi, umi_qual, r1,
    r2 (structs of seq and qual, r2 may be null)."""
    bc = F.coalesce("corrected", "barcode") if not corrected else F.col("corrected")
    kept = reads.where(F.col("corrected").isNotNull()) if corrected else reads
    front = lambda a, b, c: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), F.coalesce(c, F.lit("")))
    return kept.select("name", front(bc, F.col("umi"), F.col("r1.seq")).alias("seq1"), front(F.col("barcode_qual"), F.col("umi_qual"), F.col("r1.qual")).alias("qual1"), F.col("r2.seq").alias("seq2"), F.col("r2.qual").alias("qual2"))


def group_names(pattern: str) -> dict[str, int]:
    """Numbers of a pattern's named groups."""
    import re

    return dict(re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groupindex)


def strip_groups(text: Column, pattern: str, groups: int | list[str] | None = None) -> tuple[Column, list[Column]]:
    """The text without its captured groups, and the groups: the first `groups` ones, those of the given names, or all of a
    pattern. Groups must be separated within the pattern, so that concatenating what is between them gives the rest back;
    a group within a group leaves with it. Null where it doesn't match."""
    import re

    names = group_names(pattern)
    if groups is None:
        groups = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groups
    wanted = list(range(1, groups + 1)) if isinstance(groups, int) else [names[g] for g in groups]
    found = [F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i)) for i in wanted]
    return F.when(text.rlike(pattern), _rest(text, pattern)), found


def _rest(text: Column, pattern: str) -> Column:
    """Replaces the match by its uncaptured stretches, each made a group of its own."""
    depth, parts, now, captured, i = 0, [], "", False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            now += pattern[i : i + 2]
            i += 2
            continue
        if ch == "[":
            end = pattern.index("]", i + 1)
            now += pattern[i : end + 1]
            i = end + 1
            continue
        if ch == "(" and depth == 0 and not pattern.startswith("(?:", i):
            parts.append((False, now))
            now, captured = "", True
            skip = pattern.index(">", i) + 1 if pattern.startswith("(?<", i) and pattern[i + 3] not in "=!" else i + 1
            i, depth = skip, 1
            continue
        if ch == "(" and depth and (pattern[i + 1] != "?" or (pattern.startswith("(?<", i) and pattern[i + 3] not in "=!")):
            now += "(?:"  # a group within a group leaves with it
            i = pattern.index(">", i) + 1 if pattern[i + 1] == "?" else i + 1
            depth += 1
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0 and captured:
                parts.append((True, now))
                now, captured = "", False
                i += 1
                continue
        now += ch
        i += 1
    parts.append((False, now))
    regex, keep = "", ""
    n = 0
    for is_group, p in parts:
        head = "^" if p.startswith("^") else ""
        tail = "$" if p.endswith("$") and not p.endswith("\\$") else ""
        body = p[len(head) : len(p) - len(tail)]
        if not body:
            regex += head + tail
            continue
        if is_group:
            regex += f"{head}(?:{body}){tail}"
        else:
            n += 1
            regex += f"{head}({body}){tail}"
            keep += f"${n}"
    return F.regexp_replace(text, regex, keep)


def multiplexed(files: DataFrame, total: int) -> DataFrame:
    """Adds the barcode of each file to its reads; `files` has file_idx."""
    from ..operators.barcodes import unique_barcode

    return files.withColumn("barcode", unique_barcode("file_idx", total))
