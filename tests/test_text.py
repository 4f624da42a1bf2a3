from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import blocks, images, integrity
from folioflow.operators.tables import tables_to_markdown


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first().x


def test_normalise(spark):
    assert one(spark, T.normalize_markdown, "a b c\x0bd") == "a\nb\n\nc\nd"
    assert one(spark, T.normalize_markdown, r"\dag \dagger \ddag\Bbb{R} \Rhox") == r"\dagger \dagger \ddagger\mathbb{R} \Rhox"
    assert one(spark, T.normalize_markdown, "is $ x $ a") == "is$x$a"
    assert one(spark, T.normalize_markdown, r"x \tag{1} \tag {2}\tag{3} y \tag{4}") == r"x \tag{3} y \tag{4}"


def test_tokens(spark):
    assert one(spark, T.estimate_tokens, "hello world") == 3
    assert one(spark, T.estimate_tokens, "你好世界") == 2
    assert one(spark, T.estimate_tokens, "\U00020000\U0002f800") == 1


def test_spans(spark):
    assert one(spark, T.code_spans, "a `x` b `y z`\n`no\nne`") == ["x", "y z"]
    assert one(spark, T.mask_code, "a `x` b") == "a     b"
    assert one(spark, T.math_spans, r"$$a$$ `$b$` $c$ \$5 and $d$") == ["a", "c", "d"]
    assert one(spark, T.canonical_latex, r"\bf x \bfseries \dag b") == r"\mathbfx\bfseries\daggerb"


def test_repair(spark):
    both = lambda e, z: F.struct(integrity.repair(e, z).alias("zh"), integrity.warnings(e, z).alias("w"))
    assert tuple(one(spark, both, "see $a$ and `k`", "voir $a$ et `k`")) == ("voir $a$ et `k`", [])
    assert tuple(one(spark, both, "see $a$ and `k`", "voir $b$ et `j`")) == ("voir $a$ et `k`", ["code 0 differs", "formula 0 differs"])
    assert tuple(one(spark, both, r"$\dag x$", r"$\dagger x$")) == (r"$\dagger x$", [])
    assert one(spark, both, "$a$ $b$", "$a$").w == ["formula count 2 became 1"]
    assert one(spark, both, "`x` $a `y` b$", "`x` $a `zz` c$").zh == "`x` $a `y` b$"  # code inside a formula


def test_blocks(spark):
    split = lambda md: blocks.block_array(md)
    got = lambda md: [tuple(b) for b in one(spark, split, md)]
    assert got("one\n\n\ntwo ") == [("text", "one"), ("text", "two")]
    assert got("$$f$$\ncaption") == [("latex", "$$f$$"), ("text", "caption")]
    assert got("$$f") == [("latex", "$$f")] and got(" \n\n ") == [] and got("$$a\n\nb$$") == [("latex", "$$a"), ("text", "b$$")]


def test_tables(spark):
    table = "<table><tr><td rowspan='1'>a|b</td><td rowspan=\"2\">c</td></tr>\n<tr><th>d\ne</th></tr></table>"
    assert one(spark, tables_to_markdown, f"x {table} y") == "x | a\\|b | c |\n| --- | --- |\n| d<br>e | c | y"
    assert one(spark, tables_to_markdown, "<table><tr><td>a</td></tr></table>") == "<table><tr><td>a</td></tr></table>"
    assert one(spark, tables_to_markdown, "<TABLE><tr></tr><tr></tr></TABLE>") == "<TABLE><tr></tr><tr></tr></TABLE>"
    assert one(spark, T.drop_unit_spans, '<td rowspan="1" colspan=1 rowspan="12" colspan=\'1\'>') == '<td rowspan="12">'
    assert one(spark, T.cell_images, "![o](p) <td>![a](b.png)</td>") == '![o](p) <td><img src="b.png" style="max-height:40px;display:inline-block;" alt="a"></td>'


def test_images(spark):
    md = '![a](x/p.png) <IMG width="1" src="q.jpg"/> ![](http://h/z.png) ![c](y/p.png)'
    assert one(spark, lambda c: images.renumber(c, "d.assets"), md) == "![a](d.assets/image-1.png) ![](d.assets/image-2.jpg) ![](http://h/z.png) ![c](d.assets/image-1.png)"
    assert one(spark, lambda c: images.renumber(c, "d"), "none") == "none"


def test_names_and_backoff(spark):
    assert one(spark, lambda t: T.part_name(F.lit(7), t), " a/b:c ") == "07_a_b_c.md"
    assert one(spark, lambda t: T.part_name(F.lit(100), t), "x") == "100_x.md"
    assert one(spark, lambda r: T.backoff_seconds(F.lit(429), r, F.lit(1)), None) == 20.0
    assert one(spark, lambda r: T.backoff_seconds(F.lit(None).cast("int"), r, F.lit(1)), "x") == 10.0
    assert one(spark, lambda r: T.backoff_seconds(F.lit(429), r, F.lit(1)), "3") == 3.0
    assert one(spark, lambda t: T.rewrite_assets(t, F.lit(3), "_zh"), "![a](b_ch3_zh.assets/i.png)") == "![a](b_zh.assets/3_i.png)"
