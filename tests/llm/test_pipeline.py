"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabforge.llm.queries import TOKENIZER


def corpus():
    random.seed(31)
    de, en = [f"der{i}" for i in range(30)], [f"the{i}" for i in range(30)]
    rows = []
    for i in range(60):
        lang = "de" if i % 4 == 0 else "en"
        rows.append((i, f"{lang}{i} " + " ".join(random.choice(de if lang == "de" else en) + random.choice("abcdefgh") for _ in range(120)), lang, f"s{i % 3}", 0))
    rows.append((100, rows[5][1], "en", "s0", 0))  # exact copy
    rows.append((101, rows[7][1] + " end", "en", "s0", 0))  # near copy
    rows.append((102, "short text", "en", "s0", 0))
    rows.append((103, None, None, None, None))
    rows.append((104, rows[9][1].replace("the", "thy") + " token = \"abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71\"", "en", "s1", 0))
    rows.append((None, rows[11][1].replace("the", "tho"), "en", "s1", 0))
    return rows


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now
    ids = lambda n: sorted((r.doc_id for r in seen[n].select("doc_id").distinct().collect()), key=lambda x: -1 if x is None else x)
    assert ids("quality rules") == [None, *range(60), 100, 101, 104]
    assert ids("near duplicates") == [None, *range(60), 104] and seen["near duplicates"].count() == 62
    secret = seen["secret scan"].filter("doc_id = 104").head()
    assert secret.text.endswith(" [SECRET]\"") and secret.n_chars == len(secret.text) and seen["secret scan"].filter(F.contains("text", F.lit("[SECRET]"))).count() == 1
    assert ids("mixing") == [None, *range(60), 104] and seen["mixing"].count() >= 62
    last = seen["bpe encoding"]
    assert last.count() == seen["mixing"].count() and last.filter("NOT round_trips").count() == 0
    r = last.filter("doc_id = 3").head()
    assert list(r.ids) == Tokenizer.from_file(TOKENIZER).encode(dict((x[0], x[1]) for x in corpus())[3], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_repeated_rows_and_empty(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, 9), (1, text, "en", "s", 1, 9), (2, text, "en", "s", 1, 9), (None, text, "en", "s", 1, 9)], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1]
    other = " ".join(f"v{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, 9), (1, other, "en", "s", 1, 9), (1, other, "de", "s", 1, 9), (3, other, "en", "s", 1, 9)], docs.schema)
    assert sorted((r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [(1, other, "de"), (1, text, "en")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, f"file://{tmp_path}")
        assert now.count() == 0
