"""The pipeline: each stage and the whole against brute force, edge rows included."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobloom.llm import langid, quality
from jobloom.llm.common import release, written

from .test_bpe import PATH
from .test_decontam import slow
from .test_jaccard import slow_kept
from .test_models import SYLLABLES, prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string"


def rows():
    rng = random.Random(21)
    out = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(prose(rng, lang, rng.randint(8, 30)) for _ in range(rng.randint(2, 5)))
        out.append((i, text.replace(" ", " %%% ") if i % 6 == 0 else text, lang))
    for i in range(240, 260):  # near copies of whole texts
        words = out[i - 200][1].split(" ")
        words[len(words) // 2] = "changed"
        out.append((i, " ".join(words), out[i - 200][2]))
    item = prose(rng, "xx", 12)
    out += [(260, f"{out[1][1]} {item} {out[2][1]}", "xx"), (261, None, None), (262, "", None), (263, "123 $$$", None), (264, out[3][1], "xx"), (264, out[3][1], "xx"), (None, out[4][1], "xx")]
    return [(i, t, g, "s", None, "dot") for i, t, g in out], item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, (docs, item) = str(tmp_path_factory.mktemp("tables")), rows()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(240)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)


def test_each_stage_and_the_whole(spark, tables):
    path, all_rows, item = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    by_id = {i: t for i, t, *_ in all_rows}

    good = stages["quality"](spark, docs, path)
    scores = quality.scored(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert good.columns == docs.columns and ids(good) == ids(scores.where("predicted = 1"))
    assert sum(i % 6 == 0 for i in ids(good) if i is not None and i < 240) <= 2

    known = stages["language"](spark, good, path)
    named = langid.identified(good, langid.train(good)).where("lang_pred <> 'und'")
    assert known.columns == docs.columns and ids(known) == ids(named) and not {261, 262, 263} & set(ids(known))

    left = stages["near_duplicates"](spark, known, path)
    have = [i for i in ids(known) if i is not None]
    assert left.columns == docs.columns
    assert set(ids(left)) - {None} == slow_kept([(i, by_id[i]) for i in set(have)]) and ids(left).count(None) == ids(known).count(None)

    clean = stages["decontamination"](spark, left, path)
    bad = {i for i, r in slow([(i, by_id[i]) for i in ids(left) if i is not None], [(1, item)]).items() if r[-1]}
    assert clean.columns == docs.columns and 260 in bad and ids(clean) == [i for i in ids(left) if i not in bad]

    library, tokens = Tokenizer.from_file(PATH), stages["tokens"](spark, clean, path).collect()
    assert sorted((r.doc_id for r in tokens), key=str) == ids(clean)
    for r in tokens:
        if r.doc_id is not None:
            assert list(r.ids) == library.encode(by_id[r.doc_id], add_special_tokens=False).ids and r.intact

    before = written()
    got = corpus_pipeline.run(spark, path)
    assert sorted(tuple(r) for r in got.where("doc_id is not null").select("doc_id", "ids_sha256").collect()) == sorted((r.doc_id, r.ids_sha256) for r in tokens if r.doc_id is not None)
    assert len(written() - before) == 1  # the table that the last stage reads
    release(spark, before)
    assert written() == before


def test_empty_tables(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.count() == 0 and "a.b" in docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).collect() == []


def test_stages_pass_rows_that_share_an_id_and_clashing_names(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 120").withColumn("key", F.lit(1)).withColumn("fp", F.lit("x"))
    out = corpus_pipeline.near_duplicate_stage(spark, docs.union(docs), path)
    assert out.columns == docs.columns and out.count() == 2 * out.select("doc_id").distinct().count()
