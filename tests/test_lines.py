"""Window operators against row-at-a-time models, on random documents."""

import random
import re

from folioflow.operators import lines


def run(spark, docs, f):
    rows = lines.explode_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, md string").repartition(3))
    got = {r.doc_id: r.md for r in lines.join_lines(f(rows)).collect()}
    return [got[k] for k in range(len(docs))]


def soft(md):
    out, code, math, open_ = [], False, False, False
    for line in md.split("\n"):
        s = line.strip()
        plain = False
        if s.startswith("```"):
            code = not code
        elif code:
            pass
        elif math:
            math = not s.endswith("$$")
        elif s.startswith("$$"):
            math = s == "$$" or not s.endswith("$$")
        else:
            plain = bool(s) and not line.lstrip().startswith(lines.BLOCK_PREFIXES)
        end = out[-1].rstrip()[-1:] if out else ""
        if plain and open_ and re.match(r"\w", end):
            out[-1] += " " + line
        else:
            out.append(line)
        open_ = plain
    return "\n".join(out)


def headings(md, chapters):
    out, best, chapter, closed, warned = [], (), None, False, 0
    for line in md.split("\n"):
        m = re.match(r"^(#{1,6})\s+(\d+(?:\.\w+)*)(?:\s|$)", line)
        bare = re.sub(r"^#+\s*", "", line)
        if not m:
            t = re.match(r"^#{1,6}\s+(\S.*)", line)
            if t and re.search(lines.KEYWORDS, t[1]) and (chapter is not None or not chapters):
                closed, warned = True, warned + 1
            out.append(line)
            continue
        parts = m[2].split(".")
        if chapters:
            n = int(parts[0])
            if chapter is None or n > chapter:
                if chapter is not None:
                    best, closed = (), False
                chapter = n
            elif n < chapter:
                out.append(bare)
                continue
        if closed:
            out.append(bare)
            continue
        fixed = "#" * len(parts) + line[len(m[1]) :]
        if not all(p.isdigit() for p in parts):
            closed, warned = True, warned + 1
            out.append(fixed)
        elif tuple(map(int, parts)) <= best:
            warned += 1
            out.append(bare)
        else:
            best = tuple(map(int, parts))
            out.append(fixed)
    return "\n".join(out), warned


def images(md):
    pattern, out, src, at = re.compile(r"!\[(.*?)\]\(([^)]+)\)"), [], None, None
    for line in md.split("\n"):
        if line.strip():
            m = pattern.search(line)
            if m and m[2] == src:
                if m[1] and not pattern.search(out[at])[1]:
                    out[at] = line
                continue
            src, at = (m[2] if m else None), len(out)
        out.append(line)
    return "\n".join(out)


def random_docs(pool, seed, n=150):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_soft_wraps(spark):
    docs = random_docs(["plain", "ends.", "two words", " lead", "", "  ", "# h", "- i", "```", "```py", "$$", "$$x$$", "$$ open", "close $$", "日本", "é", "| t |", "![a](b)", "x "], 1)
    assert run(spark, docs, lines.merge_soft_wraps) == [soft(d) for d in docs]


def test_headings(spark):
    docs = random_docs(["# 1", "# 1.1 a", "## 1.2 b", "# 1.10", "### 1.2.1 c", "# 2 d", "# 2.1", "# 3", "## 1.A x", "# 2.B", "# Problems", "## References", "# Other", "text", "#no", "# 1. dot", "####### 1 deep", "# 2.1 again"], 2)
    for chapters in (True, False):
        want = [headings(d, chapters) for d in docs]
        assert run(spark, docs, lambda r, c=chapters: lines.repair_headings(r, c)) == [w[0] for w in want]
        rows = lines.explode_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, md string"))
        counts = {r.doc_id: r["count"] for r in lines.repair_headings(rows, chapters).where("warning is not null").groupBy("doc_id").count().collect()}
        assert [counts.get(k, 0) for k in range(len(docs))] == [w[1] for w in want]


def test_images(spark):
    docs = random_docs(["![](a)", "![x](a)", "![y](a)", "![](b)", "t ![z](b) u", "", " ", "text"], 3)
    assert run(spark, docs, lines.dedup_images) == [images(d) for d in docs]
