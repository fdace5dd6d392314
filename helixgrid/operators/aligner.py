"""The boundary to external aligners: anything that turns batches of reads into batches of alignments."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns that an aligner returns; mate is 1 or 2 for pairs and null for single reads.
SCHEMA = "name string, mate int, aln_idx int, flags int, chrom string, pos long, mapq int, cigar string, md string, seq string, qual string"
FASTA_ENDINGS = (".fa", ".fasta", ".fna", ".ffn", ".faa", ".frn")


class Aligner(Protocol):
    """Made once for each task; must be picklable until then."""

    def header(self) -> list[tuple[str, int]]:
        """Names and lengths of the reference sequences, in their order."""

    def align(self, reads: pa.RecordBatch) -> pa.RecordBatch:
        """Alignments of reads (name, seq1, qual1, seq2, qual2; the last two null for single reads), at least one for each
        read, unmapped ones included. Both mates of a pair come together, so that they can be placed and flagged as one."""


def align_reads(reads: DataFrame, aligner: Aligner) -> DataFrame:
    """Runs an aligner within the tasks that hold the reads; `reads`: name, seq1, qual1, seq2, qual2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield aligner.align(batch)

    return reads.select("name", "seq1", "qual1", "seq2", "qual2").mapInArrow(run, SCHEMA)


def is_fasta(path: str) -> bool:
    return path.removesuffix(".gz").endswith(FASTA_ENDINGS)
