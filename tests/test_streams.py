"""Duplicates of a stream against those of a table."""

import random

from helixgrid.operators.fragments import unique_fragments
from helixgrid.streaming.running import current_fragments, running_fragments

SCHEMA = "barcode string, chrom string, left_5p long, right_5p long, orientation string, frag_start long, frag_end long, strand string, name string, umi string"


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = rng.randrange(20)
        out.append((rng.choice(["A", "B", None]), "chr1", at, rng.choice([at + 30, None]), "FR", at + rng.randrange(3), at + rng.randrange(1, 12), rng.choice([None, "+"]), f"{seed}-{i}", rng.choice(["AC", "AG", None])))
    return out


def test_any_order_of_batches_and_a_restart(spark, tmp_path):
    parts = [rows(80, k) for k in range(4)]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        home = tmp_path / "".join(map(str, order))
        for umi in (None, "umi"):
            at = home / str(umi)
            for k in order[:2] + ["restart"] + order[2:]:
                if k != "restart":
                    spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(at / "in"))
                if k in ("restart", order[3]):  # two runs over one checkpoint, of two files each, a batch for each file
                    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
                    running_fragments(stream, str(at / "out"), str(at / "checkpoint"), umi).awaitTermination()
            got = current_fragments(spark, str(at / "out"), 4, -5, umi).collect()
            want = unique_fragments(spark.createDataFrame([r for p in parts for r in p], SCHEMA), 4, -5, umi).collect()
            assert sorted(map(str, got)) == sorted(map(str, want)) and got
            assert len(list((at / "out").glob("batch=*"))) == 4
