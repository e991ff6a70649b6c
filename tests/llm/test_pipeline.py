"""The pipeline against plain versions of its stages."""

import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, langid
from test_dealt import brute_components, sha

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(documents)
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    bits = model.centroids.shape[1].bit_length() - 1

    def known(text):
        x = langid.counts(text, bits)
        if x is None:
            return False
        cosines = model.centroids @ langid.weigh(x, model.idf)
        return cosines.max() >= model.floors[cosines.argmax(), langid._length_class(text)]

    rows = {i: t for i, t in rows.items() if known(t)}
    component, _ = brute_components(list(rows.items()), 5)
    rows = {i: t for i, t in rows.items() if component[i] == i}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) <= set(rows)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i in set(rows) - set(out):  # what decontamination took holds most words of some item
        words = set(re.findall(r"\w+", rows[i].lower()))
        assert any(len(words & (w := set(re.findall(r"\w+", x.lower())))) > 0.3 * len(w) for x in items)
    assert not any(x in rows[i] for i in out for x in items)
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in out.items():
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        text = oracle.decode(ids)
        assert ids == oracle.encode_ordinary(text) and (r["n_tokens"], r["decoded_sha256"]) == (len(ids), sha(text.encode()))
        if not re.search(r"[0-9@]|\b(?:M[rs]|Mrs|Herr|Frau|Mme|Sra?|Miss|Monsieur|Madame|Señora?)\b|Г-", rows[i]):
            assert text == rows[i]


def test_pipeline_stages_keep_the_columns(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == awkward.columns
    assert docs.where("doc_id = 0 OR text IS NULL").count() == 0


def test_pipeline_stages_of_empty_and_clashing_tables(spark, awkward, nothing):
    from pyspark.sql import functions as F

    names = ["Away", "N_Entities", "Row", "component_id", "place", "first", "n", "t", "__found", "__t", "of", "news"]
    clashing = awkward.withColumns({c: F.lit(f"clash {c}") for c in names})
    for start in (nothing, clashing):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == start.columns
        assert all(all(r[c] == f"clash {c}" for c in names) for r in docs.collect()) if start is clashing else docs.count() == 0
        assert (corpus_pipeline.encode(spark, docs, SF).count() > 0) == (start is clashing)


def test_near_copies_without_an_id_or_with_a_shared_one(spark):
    text, other = "one two three four five six seven eight nine ten eleven", "quite another text of nine words or even more"
    rows = [(None, text), (None, text), (7, other), (7, text), (7, text), (9, "short"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(7, other), (7, text), (9, "short"), (None, ""), (None, None)], key=str)
