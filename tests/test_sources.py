"""Document queries against a plain list of files."""

import hashlib
from pathlib import Path

from folioflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_document_has_an_outline_and_a_text(spark):
    sizes = {"_" + hashlib.sha256(str(p).encode()).hexdigest()[:12]: p.stat().st_size for p in Path(DATA).rglob("*.parquet")}
    assert len(sizes) > 1
    got = sorted(map(tuple, QUERIES["s2_outlines"](spark, DATA).select("doc_id", "pos", "level", "title", "page", "total_pages").collect()))
    assert got == sorted((d, k, k + 1, "ab"[k], k + 1, n) for d, n in sizes.items() for k in (0, 1))
    assert sorted(map(tuple, QUERIES["s3_parse"](spark, DATA).select("doc_id", "md", "error").collect())) == sorted((d, f"{n} bytes", None) for d, n in sizes.items())


def test_failures_come_from_a_run_over_all_parts(spark, monkeypatch):
    from folioflow.plans import pipeline

    seen = []
    monkeypatch.setattr(pipeline, "run_chapters", lambda parts, work: seen.append(parts) or {"failures": parts})
    QUERIES["x7_failures"](spark, DATA)
    assert seen[0].count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
