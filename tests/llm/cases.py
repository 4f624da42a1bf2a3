"""Awkward documents that every operator meets in its tests."""

import random

ODD = [
    None, "", " ", "\n", "  two  spaces ", "a\n\nb \n c", "tab\tand\x0bfeeds\x0c\r\nend", "▁mark ▁▁ in text", "<s>hi</s> <|endoftext|>x<|startoftext|>", "Éçole naïve ÀÉ ﬁ①",
    "汉字测试文本,没有空格", "emoji 👩‍👩‍👧 🎉!!", "İstanbul ΣΑΣ ß", "é decomposed  nbsp em\u0085nel", "x" * 300, "it's we're I'll don't 'Sx", "1234 5,678.90", "nul\x00byte", " lead", "trail ",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, rank long, chunk int, n int, label int, size long, text_ string, id long, key long, kind string, a long, b long, spans int, copies int, target string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=7, n=60):
    rng = random.Random(seed)
    made = [*ODD, *(words(rng, rng.choice([1, 4, 5, 6, 40, 300])) for _ in range(n))]
    made += [made[-1]] * 3 + [words(rng, 9000)]
    return made


def frame(spark, rows, parts=3):
    """Rows of (doc_id, text[, source]) with columns beside them whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 7, 7, 7, 7, 7, 7, "x", 7, 7, "x", 7, 7, 7, 7, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)
