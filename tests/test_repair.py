"""Repair of whole documents against a model that scans one text at a time."""

import re

from folioflow.plans import inputs
from folioflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = dict(dag="dagger", ddag="ddagger", lamba="lambda", Bbb="mathbb", Rho="rho", Epsilon="epsilon", bf="mathbf", rm="mathrm", it="textit", cal="mathcal")


def code(text):
    found, at = [], 0
    while (start := text.find("`", at)) >= 0:
        stop = next((k for k in range(start + 1, len(text)) if text[k] in "`\n"), len(text))
        at = start + 1
        if stop > start + 1 and text[stop : stop + 1] == "`":
            found.append((start, stop + 1, text[start + 1 : stop]))
            at = stop + 1
    return found


def math(text, masked):
    found, at = [], 0
    while (start := text_at(masked, at)) >= 0:
        at = start + 1
        for mark in ("$$", "$"):
            stop = masked.find(mark, start + len(mark) + 1) if masked.startswith(mark, start) else -1
            if stop >= 0:
                found.append((start, stop + len(mark), masked[start + len(mark) : stop]))
                at = stop + len(mark)
                break
    return found


def text_at(masked, at):
    while (at := masked.find("$", at)) > 0 and masked[at - 1] == "\\":
        at += 1
    return at


def same(a, b):
    return re.sub(r"\s+", "", re.sub(r"\\([a-zA-Z]+)", lambda m: "\\" + NAMES.get(m[1], m[1]), a)) == re.sub(r"\s+", "", re.sub(r"\\([a-zA-Z]+)", lambda m: "\\" + NAMES.get(m[1], m[1]), b))


def model(en, zh):
    sides = []
    for text in (en, zh):
        spans, masked = code(text), text
        for a, b, _ in spans:
            masked = masked[:a] + " " * (b - a) + masked[b:]
        sides.append((spans, math(text, masked)))
    swaps = [(y[0], y[1], en[x[0] : x[1]]) for x, y in zip(sides[0][0], sides[1][0]) if x[2] != y[2]]
    swaps += [(y[0], y[1], en[x[0] : x[1]]) for x, y in zip(sides[0][1], sides[1][1]) if not same(x[2], y[2])]
    swaps = [s for s in swaps if not any(o is not s and o[0] <= s[0] and s[1] <= o[1] for o in swaps)]
    for a, b, new in sorted(swaps, reverse=True):
        zh = zh[:a] + new + zh[b:]
    return zh


def broken(doc_id, en):
    return en.replace("$v_", "$w_").replace("`c", "`k").replace("$$x_", "$$y_") if doc_id % 4 == 0 else en


def test_every_document_is_repaired_whole(spark):
    docs = {r.doc_id: r.md for r in inputs.md(spark, DATA).collect()}
    got = {r.doc_id: r.md for r in QUERIES["p20_repair_documents"](spark, DATA).collect()}
    assert got == {k: model(en, broken(k, en)) for k, en in docs.items()}
    changed = [k for k, en in docs.items() if broken(k, en) != en]
    assert any("$$y_" in broken(k, docs[k]) for k in changed) and any(got[k] == docs[k] for k in changed)


def test_repair_of_lone_and_odd_formulas(spark):
    from pyspark.sql import functions as F

    from folioflow.operators.integrity import repair

    pairs = [("a $$x$$ b", "a $$y$$ b"), ("a $$x$ b", "a $$y$ b"), ("$a$ $$b\nc$$", "$z$ $$b\nd$$"), ("same $x$", "same $x$"), (None, "x"), ("x", None)]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, en string, zh string").select("k", repair(F.col("en"), F.col("zh")).alias("zh")).collect()
    assert [r.zh for r in sorted(got)] == [model(a, b) if a and b else b for a, b in pairs]
