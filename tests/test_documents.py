"""From files to files: discovery, parsers, chapters, images, settings."""

import json
import logging
import sys
import time

from folioflow import cli
from folioflow.operators import images, integrity
from folioflow.plans import config
from folioflow.plans.translate import CONTRACT, MARKER_CONTRACT, pause_after, with_contract
from folioflow.sources import files


def test_discovery_of_one_file_and_of_none(spark, tmp_path, caplog):
    (tmp_path / "A.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    one = files.discover(spark, f"{tmp_path}/A.PDF").collect()
    assert [(r.relative, r.length) for r in one] == [("A.PDF", 1)] and not caplog.records
    with caplog.at_level(logging.WARNING, "folioflow"):
        assert files.discover(spark, str(tmp_path)).collect() == [] and len(caplog.records) == 1  # a folder's files by their exact ending
        assert files.discover(spark, f"{tmp_path}/b.txt").collect() == [] and len(caplog.records) == 2


def test_parser_command(tmp_path):
    made = "import os, sys; d = sys.argv[2] + '/x/{}'; os.makedirs(d + '/images'); open(d + '/b.md', 'w').write(open(sys.argv[1]).read() + '{}'); open(d + '/images/i.png', 'w').write('i')"
    run = lambda code, **more: files.command_parser([sys.executable, "-c", code.replace("{", "{{").replace("}", "}}"), "{input}", "{output}"], **more)
    both = made.format("auto", "!") + "; " + made.format("hybrid_auto", "?")
    assert run(both)(b"text") == ("text?", {"i.png": b"i"}) and run(made.format("auto", "!"))(b"text") == ("text!", {"i.png": b"i"})
    assert run(made.format("else", "."))(b"text") == ("text.", {"i.png": b"i"})
    for code, says in (("print('\\n'.join(map(str, range(90)))); raise SystemExit(3)", "code 3"), ("import time; print('slow', flush=True); time.sleep(60)", "over 1 seconds"), ("print('idle')", "no text")):
        try:
            run(code, timeout=1 if "sleep" in code else 60, tail=40)(b"")
            raise AssertionError
        except files.ParserFailed as e:
            lines = str(e).split("\n")
            assert lines[0] == says and len(lines) == (41 if says == "code 3" else 2) and lines[-1] in ("89", "slow", "idle")


def test_command_line_over_chapters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    book = "cover\f= 1 One\n# 1.1 A\n![x](p.png)\f= 2 a\ntext $v$\f= 2 b\nmore\f= 1 Two\nbroken\f= 1 Three\n# 3.1 C"
    (tmp_path / "in/book.pdf").write_text(book)
    (tmp_path / "in/plain.pdf").write_text("# 1 Plain\n![](p.png)")
    (tmp_path / "in/bad.pdf").write_text("unreadable broken")
    config.save(config.load('{"run": {"max_chapter_pages": 2}}'), f"{tmp_path}/c.json")
    plugins = [x for k in ("parse", "outline", "split") for x in ({"parse": "--parser", "outline": "--outline", "split": "--splitter"}[k], f"plugins:{k}")]
    cli.main(["-i", f"{tmp_path}/in", "-o", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json", *plugins])
    out = tmp_path / "out"
    folder = next(p for p in out.iterdir() if p.is_dir() and (p / "part").exists())
    # One has three pages and two marks: in two at two pages a chapter
    assert sorted(p.name for p in (folder / "part").iterdir()) == ["00_front matter.md", "01_One — a.md", "02_One — b.md", "03_Two.md", "04_Three.md"]
    zh = next(folder.glob("*_zh.md")).read_text()
    assert zh.index("cover") < zh.index("A") < zh.index("this chapter failed") < zh.index("3.1 C") and "(book.assets/1_image-1.png)" in zh
    assert (folder / "book.assets/1_image-1.png").read_bytes().startswith(b"image of ")
    assert "broken page" in next(folder.glob("*_failed.md")).read_text()
    whole = [p for p in out.glob("*_zh.md")]
    assert len(whole) == 1 and "Plain" in whole[0].read_text() and f"({whole[0].name[:-6]}.assets/image-1.png)" in whole[0].read_text()
    assert (out / f"{whole[0].name[:-6]}.assets/image-1.png").read_bytes() == b"image of # 1 Plain"


def test_images_of_markdown_files(spark, tmp_path):
    (tmp_path / "in/pics").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("![](pics/z.png)\n\n<img src=\"pics/y.jpg\">\n\n![](http://e.org/z.png)\n\n![again](z.png) ![](lost.gif)")
    (tmp_path / "in/pics/z.png").write_bytes(b"z")
    (tmp_path / "in/pics/y.jpg").write_bytes(b"y")
    cli.main(["-i", f"{tmp_path}/in", "-o", f"{tmp_path}/out"])
    made = next((tmp_path / "out").glob("*.assets"))
    assert {p.name: p.read_bytes() for p in made.iterdir() if not p.name.startswith(".")} == {"image-1.png": b"z", "image-2.jpg": b"y"}


def test_ten_thousand_spans_and_images_in_one_text(spark):
    from pyspark.sql import functions as F

    def seconds(n):
        en = " ".join(f"`c{k}` $v_{k}$ ![](i{k % 700}.png)" for k in range(n))
        docs = spark.createDataFrame([(1, en, en.replace("$v_", "$w_"))], "doc_id long, en string, zh string")
        start = time.time()
        r = docs.select(F.size(integrity.warnings(F.col("en"), F.col("zh"))).alias("w"), integrity.repair(F.col("en"), F.col("zh")).alias("r"), images.renumber(F.col("en"), "a").alias("i")).first()
        assert r.w == n and r.r == en and f"image-{min(n, 700)}.png" in r.i
        return time.time() - start

    seconds(200)
    assert seconds(10_000) < 30


def test_settings_file_and_service(tmp_path):
    path = f"{tmp_path}/c.json"
    assert config.read(path) == config.load(None) == json.load(open(path))
    open(path, "w").write("[1]")
    assert config.read(path) == config.load(None) == json.load(open(path))
    config.save(config.load('{"run": {"workers": 3}}'), path)
    assert config.read(path)["run"]["workers"] == 3

    class Busy(Exception):
        status_code, headers = 429, {"Retry-After": "soon"}

    told = Busy()
    told.headers = {"retry-after": "3"}
    assert [pause_after(e, k) for e, k in ((Busy(), 0), (Busy(), 1), (ValueError(), 0), (ValueError(), 1), (told, 1))] == [10, 20, 5, 10, 3]
    assert with_contract(lambda system, raw: system)("a") == CONTRACT and with_contract(lambda system, raw: system)("[BLK:0]\na") == CONTRACT + MARKER_CONTRACT


def test_pauses_pass_at_the_same_time(spark, monkeypatch):
    """40 of a task's 100 requests pause for 0.5 and 1 s each, 60 s one after the other; all are tried three times."""
    from pyspark.sql import functions as F

    from folioflow.plans import translate
    from folioflow.plans.translate import Settings, call

    def failing(raw):
        if raw.startswith("0"):
            raise ValueError(raw)
        return raw

    asked = spark.range(0, 100, 1, 1).select(F.col("id"), F.when(F.col("id") % 10 < 4, F.concat(F.lit("0"), F.col("id"))).when(F.col("id") % 10 == 4, " ").otherwise(F.col("id").cast("string")).alias("raw"))
    for most in (100_000, 30):  # 30: more wait than may
        monkeypatch.setattr(translate, "WAITING", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        try:
            began = time.time()
            got = {r.id: tuple(r)[1:] for r in call(asked, failing, ["id"], Settings(patience=0.1)).collect()}
            took = time.time() - began
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {k: (None, f"ValueError('0{k}')", 3) if k % 10 < 4 else (" ", None, 0) if k % 10 == 4 else (str(k), None, 1) for k in range(100)}
        assert 1.5 <= took < 15
