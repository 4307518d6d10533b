import corpus_pipeline
from quillgraph.llm import langid, mixing, neardup, packing, pii
from quillgraph.llm.queries import MIXTURE, PACKING

from .helpers import docs, empty

COLUMNS = "doc_id text lang source n_chars".split()
SF = "/root/testdata/sf0.001"


def test_stages_against_their_own_input(spark, tmp_path):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, SF)
        before, after = read.toPandas(), out.toPandas()
        if name == "language_id":
            model = langid.train(read)
            keep = {r.doc_id for r in langid.identify(read, model).where("keep").collect()}
            assert set(after.doc_id) == keep and len(after) == len(before)
        elif name == "minhash_neardup":
            gone = set(before.doc_id) - set(after.doc_id)
            groups = [r.doc_ids for r in neardup.near_duplicates(read).collect()]
            assert gone == {d for g in groups for d in g[1:]}
        elif name == "pii":
            assert set(after.doc_id) == set(before.doc_id)
            text = dict(zip(before.doc_id, before.text))
            assert all(t == pii.masked(text[d]) and n == len(t) for d, t, n in zip(after.doc_id, after.text, after.n_chars))
        elif name == "source_mixture":
            assert set(after.doc_id) == {r.doc_id for r in mixing.mix(read, MIXTURE).collect()}
        else:
            assert sorted(after.doc_id) == sorted(before.doc_id)
            assert sorted(map(tuple, after.values.tolist())) == sorted(map(tuple, packing.pack(read, PACKING).toPandas().values.tolist()))
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, whole.values.tolist())) == sorted(map(tuple, read.toPandas().values.tolist()))


def test_stages_on_hard_rows(spark, tmp_path):
    for k, start in enumerate((docs(spark), empty(spark))):
        read = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, read, SF)
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            read = spark.read.parquet(str(tmp_path / f"{name}{k}"))
