"""The stages of the corpus pipeline on a fixture, each against a plain version."""

import re

from pyspark.sql import functions as F

from .test_operators import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    near = prose(400, 3).split()
    near[50] = "changed"
    leak = prose(40, 9)
    texts = [prose(400, 3), "\n".join(prose(400, 3).split()), " ".join(near), None, "", f"before {leak} after", *(prose(60, k) for k in (13, 17, 19))]
    rows = [(i, t, None, "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    rows += [(100 + i, f"you are an idiot moron {i}", "en", "a", 20) for i in range(60)] + [(200 + i, f"quiet garden {prose(9, i)}", "en", "b", 20) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.filter("doc_id >= 100").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") < 200).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stages = dict(pipeline.STAGES)
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    ids = lambda name, d: {r.doc_id for r in stages[name](spark, d, str(tmp_path)).select("doc_id").collect()}
    clean = ids("toxicity", docs)
    assert {i for i, *_ in rows if i >= 200 or i < 100} <= clean and len(clean & set(range(100, 200))) <= 6
    first = {}
    for i, t, *_ in rows:
        first.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), i)
    assert ids("exact_dedup", docs) == set(first.values())
    plain = docs.filter("doc_id < 100")
    assert ids("near_dedup", plain) == {i for i, *_ in rows if i < 100} - {1, 2}
    assert ids("decontamination", docs) == {i for i, *_ in rows} - {5}
    mixed = stages["mixing"](spark, plain, str(tmp_path)).collect()
    assert mixed and all(1 <= r.copies <= 3 and r.size == len((r.text or "").split()) for r in mixed)
