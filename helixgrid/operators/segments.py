"""Splitting reads into the segments of their layout, and joining segments to annotated reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import best_match, chars, revcomp

PRIMERS = ("custom_primer", "truseq_read1", "truseq_read2", "nextera_read1", "nextera_read2", "illumina_p5", "illumina_p7")
TARGETS = ("gdna", "cdna")


@dataclass(frozen=True)
class Element:
    """One element of a read's layout."""

    region_id: str
    region_type: str
    sequence_type: str
    sequence: str
    min_len: int
    max_len: int

    @property
    def fixed(self) -> bool:
        return self.min_len == self.max_len


def role(region_type: str) -> str:
    """B barcode, U UMI, P sequencing primer, T target, O other."""
    if region_type in PRIMERS:
        return "P"
    return {"barcode": "B", "umi": "U"}.get(region_type, "T" if region_type in TARGETS else "O")


def roles(region_types: str) -> str:
    """Letters of a segment; several types, joined by "+", give several letters."""
    return "".join(map(role, region_types.split("+")))


def is_target(segment_type: Column) -> Column:
    """A joined segment is a target if any of its parts is one."""
    return F.exists(F.split(segment_type, r"\+"), lambda x: x.isin(*TARGETS))


def truncated(layout: list[Element], length: int) -> list[Element]:
    """The elements that a read of `length` bases can reach: those whose greatest lengths fit, and one more if its least
    length fits."""
    out, room = [], length
    for e in layout:
        if e.max_len <= room:
            out.append(e)
            room -= e.max_len
            continue
        return [*out, e] if e.min_len <= room else out
    return out


def useful(layout: list[Element]) -> bool:
    """Whether a read of this layout has a barcode, a UMI or a target; others need not be read at all."""
    return any(role(e.region_type) in "BUT" for e in layout)


def split_fixed(seq: str, qual: str, layout: list[Element]) -> Column:
    """Segments of a layout of fixed lengths, as slices: array of (region_id, region_type, seq, qual). The last segments
    of a read that is too short are missing."""
    at, parts = 0, []
    for e in layout:
        if not e.fixed:
            raise ValueError(f"{e.region_id} has no fixed length")
        cut = lambda c, a=at, n=e.max_len: F.substring(c, a + 1, n)
        here = F.struct(F.lit(e.region_id).alias("region_id"), F.lit(e.region_type).alias("region_type"), cut(seq).alias("seq"), cut(qual).alias("qual"))
        parts.append(F.when(F.length(seq) >= at + e.max_len, here))
        at += e.max_len
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Stretch:
    """A part of a layout whose beginning is known: elements at known places, then elements whose places are open until the
    fixed sequence behind them (the anchor; none for the last stretch) is found."""

    head: tuple[Element, ...]
    open: tuple[Element, ...]
    anchor: Element | None


def stretches(layout: list[Element]) -> list[Stretch]:
    """Cuts a layout behind each anchor: the first element of fixed sequence behind one of variable length."""
    out, head, waiting = [], [], []
    for e in layout:
        if not waiting and e.fixed:
            head.append(e)
        elif waiting and e.fixed and e.sequence_type == "fixed":
            out.append(Stretch(tuple(head), tuple(waiting), e))
            head, waiting = [], []
        else:
            waiting.append(e)
    return [*out, Stretch(tuple(head), tuple(waiting), None)]


_PLACE = "array<struct<region_id:string,region_type:string,begin:int,end:int>>"


def _place(region_id: str, region_type: str, begin: Column, end: Column) -> Column:
    return F.struct(F.lit(region_id).alias("region_id"), F.lit(region_type).alias("region_type"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def _between(elements: tuple[Element, ...], begin: Column, end: Column) -> Column:
    """Places of elements between two known ends: those of fixed length are taken off the right end, what is left of them is
    one segment, of several types joined by "+" if more than one element is left."""
    cut = len(elements)
    while cut and elements[cut - 1].fixed:
        cut -= 1
    rest, tail = elements[:cut], elements[cut:]
    after = lambda i: sum(e.max_len for e in tail[i:])
    out = [_place("+".join(e.region_id for e in rest), "+".join(e.region_type for e in rest), begin, end - after(0))] if rest else []
    return F.array(*out, *(_place(e.region_id, e.region_type, end - after(i), end - after(i + 1)) for i, e in enumerate(tail)))


def _reach(elements: tuple[Element, ...], room: Column) -> list[Column]:
    """For each element, whether a read with `room` bases left reaches it: its least length fits behind the least lengths of
    those before it, whose greatest lengths do not fill the room; and so for all before it."""
    out, yes, least, most = [], F.lit(True), 0, 0
    for e in elements:
        yes = yes & (room > most) & (room >= least + e.min_len)
        out.append(yes)
        least, most = least + e.min_len, most + e.max_len
    return out


def split_reads(reads: DataFrame, layout: list[Element], key: list[str], seq: str = "seq", qual: str = "qual", reverse: bool = False, linker_tolerance: float = 1.0, anchor_tolerance: float = 0.2) -> DataFrame:
    """key, segments (array of region_id, region_type, seq, qual; null for a read that doesn't fit) and status ("ok",
    "no_sequence", "anchor_not_found" or "pattern_mismatch:n").

    A layout is cut into stretches once. A stretch begins at a known place, where its elements of known place stand; its
    anchor is the best match within the places that the lengths of its open elements allow, and may differ in
    `anchor_tolerance` of its bases; open elements lie between. A read that ends within a stretch has the elements that it
    reaches. Other fixed sequences are only checked if `linker_tolerance` is below 1. For reverse reads patterns are compared
    with the reverse complement of the window, while places are counted in the window itself. All of it are built-in
    expressions, a projection for each stretch.
    """
    if all(e.fixed for e in layout) and linker_tolerance >= 1:
        return reads.select(*key, F.when(F.col(seq).isNotNull(), split_fixed(seq, qual, layout)).alias("segments"), F.when(F.col(seq).isNull(), "no_sequence").otherwise("ok").alias("status"))
    text, n = F.col("_seq"), F.length("_seq")
    cut = lambda c, begin, end: F.substr(c, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    facing = lambda c: revcomp(c, any_case=False) if reverse else c
    x = reads.select(*(F.col(k) for k in key), F.col(seq).alias("_seq"), F.coalesce(F.col(qual), F.lit("")).alias("_qual"))
    # _at: where the stretch begins; _live: whether the read reaches it; _bad: why it does not fit.
    x = x.withColumns({"_at": F.lit(0), "_live": F.lit(True), "_bad": F.when(F.col("_seq").isNull(), "no_sequence"), "_out": F.array().cast(_PLACE)})
    for s in stretches(layout):
        at, live, out, bad = F.col("_at"), F.col("_live"), F.col("_out"), F.col("_bad")
        known, offset = [], 0
        for e, here in zip(s.head, _reach(s.head, n - at), strict=True):
            place = _place(e.region_id, e.region_type, at + offset, at + offset + e.max_len)
            known.append(F.when(live & here, place))
            if e.sequence_type == "fixed" and linker_tolerance < 1:
                window = facing(cut(text, at + offset, at + offset + e.max_len))
                miss = sum((F.when(F.substring(window, i + 1, 1) != ch, 1).otherwise(0) for i, ch in enumerate(e.sequence)), F.lit(0))
                bad = F.when(bad.isNull() & live & here & (miss > linker_tolerance * e.max_len), F.concat(F.lit("pattern_mismatch:"), miss.cast("string"))).otherwise(bad)
            offset += e.max_len
        whole = _reach(s.head, n - at)[-1] if s.head else F.lit(True)
        x = x.withColumns({"_out": F.concat(out, F.filter(F.array(*known).cast(_PLACE), lambda p: p.isNotNull())), "_live": live & whole, "_bad": bad, "_at": at + offset})
        if not s.open:
            continue
        least, most = sum(e.min_len for e in s.open), sum(e.max_len for e in s.open)
        reached = _reach(s.open + ((s.anchor,) if s.anchor else ()), n - at)
        if s.anchor:
            window = facing(cut(text, at + least, F.least(n, at + most + s.anchor.max_len)))
            x = x.withColumns({"_hit": F.when(live & bad.isNull() & reached[-1], best_match(window, s.anchor.sequence))})
            sought, miss = F.col("_hit").isNotNull(), F.col("_hit.mismatches")
            close = miss <= anchor_tolerance * len(s.anchor.sequence)
            beyond = at + most + s.anchor.max_len > n
            x = x.withColumns({
                "_found": sought & F.col("_hit.pos").isNotNull() & close,
                "_bad": F.when(sought & F.col("_hit.pos").isNull(), "anchor_not_found").when(sought & ~close & ~beyond, F.concat(F.lit("pattern_mismatch:"), miss.cast("string"))).otherwise(F.col("_bad")),
            })
            anchor = at + least + F.col("_hit.pos")
            closed = F.concat(_between(s.open, at, anchor), F.array(_place(s.anchor.region_id, s.anchor.region_type, anchor, anchor + s.anchor.max_len)))
        else:
            x, anchor, closed = x.withColumn("_found", F.lit(False)), at, F.array().cast(_PLACE)
        cases = F.when(F.col("_found"), closed.cast(_PLACE))
        for k in range(len(s.open), 0, -1):
            end = F.least(at + sum(e.max_len for e in s.open[:k]), n)
            cases = cases.when(live & reached[k - 1], _between(s.open[:k], at, end).cast(_PLACE))
        x = x.withColumns({"_out": F.concat(out, cases.otherwise(F.array().cast(_PLACE))), "_live": F.col("_found"), "_at": F.when(F.col("_found"), anchor + (s.anchor.max_len if s.anchor else 0)).otherwise(at)})
    part = lambda p: F.struct(p["region_id"].alias("region_id"), p["region_type"].alias("region_type"), cut(F.col("_seq"), p["begin"], p["end"]).alias("seq"), cut(F.col("_qual"), p["begin"], p["end"]).alias("qual"))
    return x.select(*key, F.when(F.col("_bad").isNull(), F.transform("_out", part)).alias("segments"), F.coalesce("_bad", F.lit("ok")).alias("status"))


def shown(segments: Column | str) -> Column:
    """Text form of segments, such as [B]ACGT,[U]AC."""
    letter = lambda t: F.when(t.isin(*PRIMERS), "P").when(t == "barcode", "B").when(t == "umi", "U").when(t.isin(*TARGETS), "T").otherwise("O")
    letters = lambda x: F.array_join(F.transform(F.split(x["region_type"], r"\+"), letter), "")
    return F.array_join(F.transform(segments, lambda x: F.concat(F.lit("["), letters(x), F.lit("]"), x["seq"])), ",")


def annotate(split: DataFrame, reverse: bool = False) -> DataFrame:
    """Adds barcode, barcode_qual, umi, umi_qual, target and target_qual. Parts of barcodes and UMIs are joined in order
    and, for reverse reads, turned round one by one; the target is not turned."""
    of = lambda t: F.filter("segments", lambda x: x["region_type"] == t)
    seq = lambda x: revcomp(x["seq"]) if reverse else x["seq"]
    qual = lambda x: F.reverse(x["qual"]) if reverse else x["qual"]
    joined = lambda t, f: F.when(F.size(of(t)) > 0, F.array_join(F.transform(of(t), f), ""))
    target = F.filter("segments", lambda x: is_target(x["region_type"]))
    return split.withColumns(
        {
            "barcode": joined("barcode", seq),
            "barcode_qual": joined("barcode", qual),
            "umi": joined("umi", seq),
            "umi_qual": joined("umi", qual),
            "target": F.get(target, F.lit(0))["seq"],
            "target_qual": F.get(target, F.lit(0))["qual"],
        }
    )


def layout_sample(split: DataFrame, onlists: dict[str, DataFrame], sample: int = 1000, reverse: bool = False) -> dict[str, float]:
    """Share of the first `sample` reads that fit the layout, and for each barcode region the share found on its list;
    values below one half deserve a warning. A limit is the point of this check."""
    head = split.limit(sample)
    ok = head.agg(F.avg((F.col("status") == "ok").cast("double"))).first()[0]
    out = {"fits": ok if ok is not None else 0.0}
    for region, onlist in onlists.items():
        parts = head.select(F.explode("segments").alias("x")).where(F.col("x.region_id") == region).select((revcomp("x.seq") if reverse else F.col("x.seq")).alias("barcode"))
        known = onlist.select("barcode").distinct().withColumn("hit", F.lit(1.0))
        share = parts.join(known, "barcode", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0)))).first()[0]
        out[region] = share if share is not None else 0.0
    return out


def infer_lengths(reads: DataFrame, seq: str = "seq", sample: int = 1000) -> tuple[int, int]:
    """Least and greatest length of the first `sample` reads."""
    r = reads.limit(sample).agg(F.min(F.length(seq)), F.max(F.length(seq))).first()
    return (r[0] or 0, r[1] or 0)


def mean_quality(qual: Column | str) -> Column:
    """Mean Phred score of a quality text."""
    q = F.transform(chars(qual), lambda c: F.ascii(c) - 33)
    return F.try_divide(F.aggregate(q, F.lit(0), lambda a, x: a + x).cast("double"), F.size(q))
