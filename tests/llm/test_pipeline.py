"""The pipeline's stages against their operators, and the entry module."""

import random
import tempfile

import corpus_pipeline as cp
from helixgrid.llm.language import language_id
from helixgrid.llm.near_dup import near_duplicates
from helixgrid.llm.queries import queries
from helixgrid.llm.toxicity import toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    toxic = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=None).where("predicted = 1")
    one = cp.drop_toxic(spark, docs, sf_dir).cache()
    assert one.columns == docs.columns and ids(one) == ids(docs) - ids(toxic) and ids(toxic)
    two = cp.keep_languages(spark, one, sf_dir).cache()
    bad = language_id(one, held_out=None).where("lang_pred = 'und' or score < 0.5")
    assert ids(two) == ids(one) - ids(bad)
    three = cp.drop_near_duplicates(spark, two, sf_dir).cache()
    assert ids(three) == ids(near_duplicates(two).where("kept")) and three.count() == len(ids(three))
    four = cp.pack_documents(spark, three, sf_dir)
    assert ids(four) == ids(three)


def test_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, "the and of that with", "en", "s", 1), (1, "the and of that with", "en", "s", 1), (None, "the and of", "en", None, None), (2, None, "en", None, None), (3, "", None, None, None), (4, "the and of that with", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    x = docs
    for _, stage in cp.STAGES[:-1]:
        x = stage(spark, x, sf_dir).cache()
        assert x.columns == docs.columns
    assert sorted([r.doc_id for r in x.collect()], key=str) == [1, None]  # a clean row stays without an id
    assert cp.STAGES[-1][1](spark, x, sf_dir).count() == 2
    for _, stage in cp.STAGES:
        stage(spark, docs.limit(0), sf_dir).collect()


def test_decisions_against_plain_versions(spark):
    """Near duplicates against all pairs, and languages and toxicity against what was planted, over the stages."""
    rng = random.Random(31)
    common = {"en": "the of and to in that it was with for".split(), "fr": "le la les et des que dans pour une est".split()}
    rows, toxic, strange = [], set(), set()
    for i in range(240):
        lang = "en" if i % 3 else "fr"
        words = [rng.choice(common[lang]) if rng.random() < 0.5 else rng.choice(common[lang]) + rng.choice(["ing", "able", "ment", "eux"]) for _ in range(60)]
        if i % 8 == 0:
            words[rng.randrange(60)] = words[rng.randrange(60)] = "schurke"
            toxic.add(i)
        if i % 40 == 7:
            words, lang = ["1234", "5678 #", str(i)], None
            strange.add(i)
        rows.append((i, " ".join(words), lang, "s", 1))
    for k in range(30):  # near copies of clean documents
        i, t = rng.choice([(i, t) for i, t, *_ in rows[:200] if i not in toxic | strange])
        rows.append((1000 + k, t + " tail", "en" if i % 3 else "fr", "s", 1))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    folder = tempfile.mkdtemp(prefix="spark-pipeline-")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows[:240]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = cp.drop_toxic(spark, docs, folder).cache()
    assert len(ids(one) & toxic) <= 1 and len(ids(one) - toxic) >= 0.98 * len({r[0] for r in rows} - toxic)
    two = cp.keep_languages(spark, one, folder).cache()
    assert not ids(two) & strange and len(ids(two)) >= 0.98 * len(ids(one) - strange)
    three = cp.drop_near_duplicates(spark, two, folder).cache()
    kept, sets = [], {r.doc_id: {tuple(w[j : j + 5]) for w in [r.text.split()] for j in range(max(1, len(w) - 4))} for r in two.collect()}
    for i in sorted(sets):  # copies of one document are linked with it alone
        if all(len(sets[i] & sets[j]) < 0.75 * len(sets[i] | sets[j]) for j in kept):
            kept.append(i)
    assert ids(three) == set(kept) and three.count() == len(kept)
    pieces = cp.pack_documents(spark, three, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11)) and list(cp.queries()) == ["pipeline"]
