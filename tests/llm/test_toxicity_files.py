"""A model of more entries than are broadcast: read from files, with the ratios of the broadcast one, and texts stay where they are."""

import random

import numpy as np
import pytest

from helixgrid.llm import batches, toxicity


@pytest.fixture(scope="module")
def learned(spark):
    batches.small_batches(spark)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), i % 2) for i in range(400)]
    model, scalars = toxicity.entries(spark.createDataFrame(texts, "text string, y int"))
    read = [(i, t) for i, (t, _) in enumerate(texts[:150])] + [(900, None), (901, ""), (902, "zebra, new words " + "x" * 50), (903, "ab " * 5000)]
    return spark.createDataFrame(read, "id long, text string"), model, scalars


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("entries", [7, 200, 1_000_000])
def test_files(learned, monkeypatch, entries):
    read, model, scalars = learned
    want = sorted(map(tuple, toxicity.summaries(read, model, scalars).collect()))
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 0)
    monkeypatch.setattr(toxicity, "FILE_ENTRIES", max(entries, model.count() // 40))
    found = toxicity.summaries(read, model, scalars)
    assert "Exchange" not in _nodes(found) and "CoGroup" not in _nodes(found)
    assert sorted(map(tuple, found.collect())) == want


def test_shared_folder_of_spark_alone(learned, monkeypatch):
    """Where Python does not reach the shared folder, texts are joined; and copies of files that are not local are mapped."""
    read, model, scalars = learned
    want = sorted(map(tuple, toxicity.summaries(read, model, scalars).collect()))
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 0)
    monkeypatch.setattr(toxicity, "_reached", lambda folder: False)
    assert np.allclose(want, sorted(map(tuple, toxicity.summaries(read, model, scalars).collect())), atol=1e-9)


def test_reached(tmp_path):
    assert toxicity._reached(f"file://{tmp_path}/a") and not toxicity._reached("viewfs://store/a") and not toxicity._reached("/proc/none/a")


def test_copies_of_files_elsewhere(spark, learned, monkeypatch):
    from pyarrow import fs

    _, model, _ = learned
    folder = f"{batches.shared_dir(spark)}/entries-test"
    assert toxicity._reached(folder)
    files = toxicity._stored(model, folder, model.count())
    here = toxicity._mapped(files)
    away = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    monkeypatch.setattr(toxicity, "open_path", lambda path: (away, path.removeprefix("file://").lstrip("/")))
    for a, b in zip(here, toxicity._mapped(files), strict=True):
        for x, y in zip(a, b, strict=True):
            assert np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1])
    keys = [k for k, _ in here[toxicity.SINGLE]]
    assert np.array_equal(np.concatenate(keys), np.sort(np.concatenate(keys)))


def test_no_entries():
    empty = toxicity.StoredModel([[]] * 5, {"share": [1.0, 1.0], "new": [0.1, 0.2]})
    assert empty.summaries(["a b", None]) == toxicity.Model([(np.zeros(0, np.int64), np.zeros((0, 2)))] * 5, {"share": [1.0, 1.0], "new": [0.1, 0.2]}).summaries(["a b", None])
