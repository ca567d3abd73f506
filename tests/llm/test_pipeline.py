"""run() against the operators' plain versions, and the registered queries."""

import hashlib

import __spark_entry__ as entry
import corpus_pipeline
from loomq.llm import personal_data, quality_rules, source_mix
from loomq.llm.piece_viterbi import Pieces
from loomq.llm.queries import tokenizer_path

from test_token_groups import plain

SF = "/root/testdata/sf0.001"


def test_run_equals_a_plain_version(spark):
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    found = plain([(r.doc_id, r.text) for r in rows], 5, 75)
    rows = [r for r in rows if found[r.doc_id][1] == r.doc_id]
    n = {s: sum(r.source == s for r in rows) for s in source_mix.WEIGHTS}
    rate = source_mix.rates(n, source_mix.WEIGHTS)
    steps = {s: source_mix.thresholds(x) for s, x in rate.items()}
    held, want = Pieces(tokenizer_path("piece_bpe_32k.model")), []
    for r in rows:
        u = int(hashlib.md5(f"mix|0|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        ids = held.encode(pa.array([personal_data.redact(r.text)]))[1]
        want += [(r.doc_id, tuple(np.asarray(ids).tolist()))] * sum(t <= u for t in steps[r.source])
    got = [(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(got) > 20 and sorted(got) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "source mix", "token ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where("size(split(trim(text), '\\\\s+')) >= 60")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    ids = [r.doc_id for r in clean.collect()]
    assert sum(i in kept for i in ids) > 0.99 * len(ids)


def test_registered_once_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_stand_odd_rows(spark, odd):
    import random

    from pyspark.sql import functions as F

    from llm_cases import invented

    rng = random.Random(9)
    texts = [invented(rng, 120) + "." for _ in range(3)]
    more = [(100, texts[0]), (101, texts[0]), (101, texts[0]), (None, texts[1]), (None, texts[1]), (102, texts[2] + " mail a@b.co " + invented(rng, 60_000) + ".")]
    rows = odd.unionByName(spark.createDataFrame([(i, t, "en", "src1") for i, t in more], odd.schema.fieldNames()[:4]), allowMissingColumns=True)
    docs = rows.withColumn("N_chars", F.length("text").cast("long"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept[name] = sorted((r.doc_id or 0 for r in docs.collect()))
        assert all(r.N_chars == len(r.text) for r in docs.collect())
    assert kept["quality rules"] == [0, 0, 100, 101, 101, 102] and kept["near duplicates"] == [0, 0, 100, 102] == kept["personal data"]
    assert "mail <EMAIL> " in {r.doc_id: r.text for r in docs.collect()}.get(102, "mail <EMAIL> ") and set(kept["source mix"]) <= {0, 100, 102}
    out = corpus_pipeline.token_ids(spark, docs, SF)
    assert out.columns == ["doc_id", "ids"] and out.count() == docs.count()
