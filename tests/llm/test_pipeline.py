import json
import os
import subprocess
import sys
import zlib

import __spark_entry__
import corpus_pipeline
from folioflow.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_dedup", "source_mixing", "best_fit_packing"]
    lex = toxicity.fit(docs, labels)
    first = corpus_pipeline.drop_toxic(spark, docs, DATA)
    rejected = {r.doc_id for r in toxicity.score(docs, lex).where("predicted = 1").collect()}
    assert rejected and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - rejected and first.columns == docs.columns

    second = corpus_pipeline.drop_near_duplicates(spark, first, DATA)
    kept = {r.component_id for r in jaccard_join.join(first).collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted(kept) and second.columns == docs.columns

    third = corpus_pipeline.drop_repeated_passages(spark, second, DATA)
    removed = {r.doc_id: r for r in suffix_dedup.deduplicate(second).collect()}
    texts = {r.doc_id: r.text for r in third.collect()}
    assert set(texts) == kept and third.columns == docs.columns and any(r.n_removed for r in removed.values())
    assert all(0 <= len(texts[d].encode()) - (r.n_bytes - r.n_removed) <= 6 * r.n_spans for d, r in removed.items())

    fourth = corpus_pipeline.mix_sources(spark, third, DATA)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(third).collect() if r.taken}
    counts = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert counts == taken and fourth.columns == docs.columns

    last = corpus_pipeline.pack_sequences(spark, fourth, DATA).collect()
    assert {r.doc_id for r in last} == set(taken) and len(last) >= sum(taken.values())
    by = {}
    for r in last:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= packing.CAPACITY
    assert sum(r.length for r in last) / (packing.CAPACITY * len(by)) > 0.8


def test_registered_and_removable(tmp_path):
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for entry in os.listdir(root):
        if entry in ("__spark_entry__.py", "folioflow"):
            subprocess.run(["cp", "-r", f"{root}/{entry}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/folioflow/llm"], check=True)
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries()))); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    left = set(json.loads(out.stdout.splitlines()[-1]))
    assert left == {n for n in names if not n.startswith("op") and n != "pipeline"}


def test_folds_are_of_the_id_as_text(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50).select("id", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
