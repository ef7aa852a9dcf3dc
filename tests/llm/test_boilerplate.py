import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from parchmill.llm import boilerplate as b
from tests.conftest import rows


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(0, 3) for _ in range(rng.randint(1, 30))]
        order, prefix = b.suffix_array(np.array(s))
        assert list(order) == sorted(range(len(s)), key=lambda i: s[i:])
        for k in range(1, len(s)):
            x, y = s[order[k - 1] :], s[order[k] :]
            n = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert prefix[k] == n


def test_lines_that_agree():
    assert b.line_id("Contact:  R. Foo,  extension 113") == b.line_id(" contact: r. foo, EXTENSION 7 ")
    assert b.line_id("Page 1,000 of the report") != b.line_id("Page 5 of the report")


def data(rng):
    notices = [f"All rights reserved by the issuer {n}" for n in "abc"] + ["short"]
    out = []
    for k in range(400):
        source = rng.choice(["hot"] * 5 + ["x", "y", "z"])
        lines = [f"Sentence of its own {k} {n} {rng.random()}".replace("0.", "word") + "".join(rng.choices("abcdef", k=12)) for n in range(rng.randint(0, 4))]
        for n in notices:
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), n.upper() if rng.random() < 0.5 else n + " ")
        out.append((k, None if k == 3 else "\n".join(lines), {0: None, 1: []}.get(k, [source] + (["x"] if k % 17 == 0 else []) + ([source] if k % 5 == 0 else []))))
    return out


def deleted(made, documents=8):
    """By brute force: the wide and the short lines of blocks of one or more lines, with a wide line, in enough documents."""
    seen = {k: [(n, b.line_id(line), sum(map(str.isalnum, line)) >= 12) for n, line in enumerate((t or "").split("\n")) if any(map(str.isalnum, line))] for k, t, _ in made}
    docs = defaultdict(set)
    for k, _, s in made:
        for x in set(s or ()):
            for i in range(len(seen[k])):
                for j in range(i, len(seen[k])):
                    docs[x, tuple(h for _, h, _ in seen[k][i : j + 1])].add(k)
    wide, short = set(), set()
    for k, _, s in made:
        for x in set(s or ()):
            for i in range(len(seen[k])):
                for j in range(i, len(seen[k])):
                    block = seen[k][i : j + 1]
                    if len(docs[x, tuple(h for _, h, _ in block)]) >= documents and any(w for _, _, w in block):
                        wide |= {(k, n) for n, _, w in block if w}
                        short |= {(k, n) for n, _, w in block if not w}
    return sorted(wide), sorted(short)


def test_against_counting(spark):
    made = data(random.Random(2))
    df = spark.createDataFrame(made, "record_id long, core_text string, s array<string>").withColumn("line", F.lit("clash"))
    wide, short = deleted(made)
    assert wide and short
    for chunk in (100_000, 40):
        found = b.repeated_lines(df, "record_id", F.col("s"), "core_text", chunk=chunk)
        assert sorted(map(tuple, found.filter("wide").select("id", "line_no").distinct().collect())) == wide
        assert sorted(map(tuple, found.filter("NOT wide").select("id", "line_no").distinct().collect())) == short
    for gone in (wide, sorted(wide + short)):
        places = spark.createDataFrame(gone, "record_id long, line_no long")
        left = {r[0]: (r[1], r[2]) for r in b.without_lines(df, "record_id", "core_text", places).select("record_id", "core_text", "removed").collect()}
        for k, t, _ in made:
            rest = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (k, n) not in set(gone))
            assert left[k] == (rest, sum(k == x for x, _ in gone))
    assert b.repeated_lines(df.limit(0), "record_id", F.col("s"), "core_text").count() == 0


def test_a_block_decides_about_a_short_line(spark):
    """A short line goes with the notice it stands in, and stays where it stands alone, however often."""
    made = [(k, f"Own text {'abcdefghij'[k]} of the record\nAll rights reserved by us\nShare\n\n—\nTweet\nRead our terms of use here", ["s"]) for k in range(9)]
    made += [(20 + k, f"Own text {'klmnopqrst'[k]} of the record\nShare", ["s"]) for k in range(9)] + [(40, "Share\nRead our terms of use here\nTweet", ["s"]), (41, "?\n \n", ["s"])]
    df = spark.createDataFrame(made, "record_id long, core_text string, s array<string>")
    for chunk in (100_000, 9):
        found = rows(b.repeated_lines(df, "record_id", F.col("s"), "core_text", chunk=chunk).select("id", "line_no", "wide"))
        assert found == sorted([(k, n, n in (1, 6)) for k in range(9) for n in (1, 2, 5, 6)] + [(40, 1, True)])


def test_common_prefixes_take_no_longer_for_equal_documents():
    import time

    took = []
    for n in (20_000, 80_000):
        ids = np.concatenate((np.arange(n), [n], np.arange(n), [n + 1]))
        began = time.process_time()
        assert b.suffix_array(ids)[1].max() == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_blocks_of_several_lines(spark):
    block = ["First line of the notice", "Second line of the notice", "Third line of the notice"]
    df = spark.createDataFrame([(k, "\n".join([f"Own text {'abcdefghij'[k]} of the record", *block]), ["s"]) for k in range(9)], "record_id long, core_text string, s array<string>")
    found = b.repeated_lines(df, "record_id", F.col("s"), "core_text")
    assert rows(b.repeated_blocks(found).select("documents", "longest")) == [(9, 1), (9, 2), (9, 3)]


def test_issuers(spark):
    df = spark.sql("SELECT named_struct('filing', named_struct('ciks', array('0071', '71', ' 9 ', '', null, '000'))) AS metadata")
    assert df.select(b.issuers()).first()[0] == ["71", "71", "9", "0"]


def test_blocks_over_the_parts_of_a_source(spark):
    rng, made = random.Random(5), []
    notices = [f"{w} line of the notice to holders" for w in "first second third fourth fifth".split()]
    for k in range(60):
        lines = [f"Own text of the record {''.join(rng.choices('abcdefgh', k=20))}"]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 4)
            lines += notices[a : rng.randint(a + 1, 5)] + ["short"] * rng.randint(0, 1)
        made.append((k, "\n".join(lines), [rng.choice(["s", "s", "t"])]))
    gone, docs = {x for part in deleted(made) for x in part}, defaultdict(set)
    for k, text, (source,) in made:
        lines = [b.line_id(x) if (k, n) in gone else None for n, x in enumerate(text.split("\n"))]
        for a in range(len(lines)):
            for e in range(a + 1, len(lines) + 1):
                if None not in lines[a:e]:
                    docs[source, tuple(lines[a:e])].add(k)
    want = {}
    for (source, block), who in docs.items():
        if len(who) >= 8:
            want[source, block[0]] = (len(docs[source, block[:1]]), max(len(block), want.get((source, block[0]), (0, 0))[1]))
    assert max(n for _, n in want.values()) > 1
    df = spark.createDataFrame(made, "record_id long, core_text string, s array<string>")
    for chunk in (100_000, 20):
        found = b.repeated_lines(df, "record_id", F.col("s"), "core_text", chunk=chunk)
        assert {(r["source"], r["line"]): (r["documents"], r["longest"]) for r in b.repeated_blocks(found).collect()} == want
