"""The operators on small relations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import faults as FA
from quire.operators import job as J
from quire.operators import library as LB
from quire.operators import merge as M
from quire.operators import recall as R
from quire.operators import segments as S
from quire.plans import prompts as P
from quire.plans import render as RE
from quire.sources import answers as A
from quire.sources import images as I
from quire.sources import tables as T
from quire.streaming import progress as ST


def merged(spark, *sections, strict=True):
    rows = [(1, k, s) for k, s in enumerate(sections)]
    return M.merge_pages(spark.createDataFrame(rows, "page long, index int, text string"), strict=strict).first()["text"]


def test_merge(spark):
    assert merged(spark, "alpha one\nbeta two\ngamma three", "beta two\ngamma three\ndelta four") == "alpha one\nbeta two\ngamma three\ndelta four"
    assert merged(spark, "alpha one\nbeta twoo\ngamma three", "beta two\ngamma three\ndelta four") == "alpha one\nbeta twoo\ngamma three\ndelta four"
    assert merged(spark, "first half", "other words") == "first half\n\nother words"
    assert merged(spark, "same\ntext here", "same\ntext here") == "same\ntext here"
    assert merged(spark, "aa bb cc\ndd ee ff", "dd ee ff\ngg hh ii", "gg hh ii\njj kk ll") == "aa bb cc\ndd ee ff\ngg hh ii\njj kk ll"
    assert merged(spark, "aa bb", None, "cc dd") == "aa bb\n\ncc dd"
    assert merged(spark, "", "x") == "x"


def test_merge_at_punctuation(spark):
    parts = ("# A\n- x one\n---", "# Head\n\n- Presales\n- more")
    assert "# Head" in merged(spark, *parts) and "# Head" not in merged(spark, *parts, strict=False)


def lines_of(spark, texts):
    """(line, normal form, blank) as the merge gets them."""
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k")
    return [(r.x, r.n, r.b) for r in df.select("x", X.normalise(F.col("x")).alias("n"), X.is_empty(F.col("x")).alias("b"), "k").orderBy("k").collect()]


def test_best_seam_agrees_with_the_fold(spark):
    above, below = ["a a a", "beta two", "", "gamma three"], ["beta two", "", "gamma thre", "delta four"]
    df = spark.createDataFrame([(1, 1, above, below)], "page long, index int, above array<string>, below array<string>")
    r = M.best_seams(df).first()
    assert (r.keep, r.resume) == M.seam(lines_of(spark, above), lines_of(spark, below), False) == (4, 3)


def test_one_similarity(spark):
    pairs = [("हिन्दी में लिखा", "हिंदी में लिखा"), ("ΟΔΟΣ ΜΑΣ", "οδος μας"), ("naïve café", "NAIVE CAFE"), ("a\x1c b", "ab"), ("--", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select(X.similarity(F.col("a"), F.col("b")).alias("s"), X.normalise(F.col("a")).alias("x"), X.normalise(F.col("b")).alias("y"))
    assert all(r.s == pytest.approx(M.similar(r.x, r.y)) for r in df.collect())
    assert merged(spark, "राम घर गया\nहिन्दी में लिखा", "हिन्दी मे लिखा\nऔर आगे") == "राम घर गया\nहिन्दी में लिखा\nऔर आगे"


def test_merge_against_a_plain_fold(spark):
    """Sections of the documents, merged by a fold that is written out from the rule alone."""
    from quire.plans import catalog

    answers = catalog._section_answers(spark, "/root/testdata/sf0.001").where("page < 60")
    rows = answers.select("page", "index", X.lines("text").alias("ls"), F.transform(X.lines("text"), X.normalise).alias("ns")).orderBy("page", "index").collect()

    def sim(a, b):
        if a == b:
            return 1.0
        x, y = [a[i : i + 2] for i in range(len(a) - 1)], [b[i : i + 2] for i in range(len(b) - 1)]
        return 2 * sum(min(x.count(g), y.count(g)) for g in set(x)) / (len(x) + len(y)) if x and y else 0.0

    pages = {}
    for r in rows:
        below = list(zip(r.ls, r.ns))
        if r.page not in pages:
            pages[r.page] = below
            continue
        above, best = pages[r.page], (0.0, len(pages[r.page]), 0)
        for i in range(max(0, len(above) - 14), len(above)):
            for j in range(min(14, len(below))):
                if above[i][0].strip() and above[i][1] and sim(above[i][1], below[j][1]) >= 0.8:
                    n, score = 0, i / len(above) + 0.5 * (1 - j / len(below))
                    while i + n < len(above) and j + n < len(below):
                        (a, x), (b, y) = above[i + n], below[j + n]
                        if a.strip() or b.strip():
                            if sim(x, y) < 0.62:
                                break
                            score += 2 + sim(x, y)
                        n += 1
                    if score > best[0]:
                        best = (score, i + n, j + n)
        kept = above[: best[1]]
        if not best[2] and not (kept and not kept[-1][0].strip()):
            kept.append(("", ""))
        pages[r.page] = kept + below[best[2] :]
    got = {r.page: r.text for r in M.merge_pages(answers).collect()}
    assert len(got) > 30 and got == {p: "\n".join(x for x, _ in ls).strip("\n") for p, ls in pages.items()}


def test_merge_of_long_and_short_sections(spark):
    """A page of 100,000 lines; seams that reach back over several short sections; rows that repeat an index; no Python."""
    part = lambda k: "\n".join(f"line {i * 7919} of {i}" for i in range(k * 20_000, (k + 1) * 20_000 + 5))
    rows = [(1, k, part(k)) for k in range(5)] + [(2, k, f"word{k}x one\nword{k + 1}x one") for k in range(40)]
    rows += [(3, 0, "bb zz"), (3, 0, "aa yy"), (4, 0, ""), (4, 1, "\n \n"), (5, 0, "a b c d\ne f g h\ni j k l"), (5, 1, "i j k l"), (5, 2, "e f g h\ni j k l\nm n o p")]
    df = M.merge_pages(spark.createDataFrame(rows, "page long, index int, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.page: r.text for r in df.collect()}
    assert got[1].split("\n") == [f"line {i * 7919} of {i}" for i in range(100_005)]
    assert got[3] == "aa yy\n\nbb zz" and got[4] == "" and got[5] == "a b c d\ne f g h\ni j k l\nm n o p"
    merged = None
    for page, _, text in rows:
        if page == 2:
            merged = M.joined(merged, lines_of(spark, text.split("\n")))
    assert got[2] == M.text_of(merged)


def test_blank_runs_and_pages(spark):
    rows = [(1, i, b) for i, b in enumerate([255, 255, 0, 255, 0, 255, 255, 255])] + [(2, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, row int, brightness int")
    assert sorted(map(tuple, S.blank_runs(df, 246, F.lit(2)).collect())) == [(1, 0, 2), (1, 5, 8)]
    paged = {r.doc_id: (r.height, [tuple(x) for x in r.runs]) for r in S.pages(df, 246, F.lit(2)).collect()}
    assert paged == {1: (8, [(0, 2), (5, 8)]), 2: (1, [])}


def test_coverage_gaps_of_a_page_with_two_gaps(spark):
    page = spark.createDataFrame([(1, 17002, [(5000, 5060), (6500, 6560)])], "doc_id long, height int, runs array<struct<start:int,end:int>>")
    sectioned = S.with_sections(page, F.lit(2267))
    assert len(sectioned.first()["sections"]) == 9
    assert sorted(map(tuple, S.coverage_gaps(S.section_rows(sectioned)).collect())) == [(1, 1927, 2154), (1, 4421, 4648)]


def test_recall(spark):
    docs = spark.createDataFrame([(1, "The Quick-Brown fox"), (2, None), (3, "quick bro wnfox")], "doc_id long, text string")
    anchors = spark.createDataFrame([(1, "quick brown"), (2, "lazy dog"), (3, "")], "item_id long, text string")
    hits = R.anchor_hits(docs, anchors)
    assert {r.doc_id: (r.found, r.total) for r in R.recall(hits).collect()} == {1: (2, 3), 2: (1, 3), 3: (2, 3)}
    assert {r.doc_id: r.missing for r in R.missing(hits).collect()} == {1: "2", 2: "1,2", 3: "2"}
    none = R.recall(R.anchor_hits(docs, anchors.limit(0))).first()
    assert (none.found, none.total, none.fraction) == (0, 0, 1.0)


FAULTS = [
    ("A clean line\n- one\n- two", []), ("  \n", ["not empty"]), (None, ["not empty"]), ("```\nx\n```", ["no code fence"]), ("\nSure, here it is", ["no preamble"]),
    ("- a\n\n---\n\n- b", ["no rule between bullets"]), ("- a\n---\ntext", []), ("- a\n   - b", ["nesting in twos"]), ("- a\n  - b", []),
    ("x\nsame\nsame \nsame\n same", ["no repetition loop"]), ("same\nsame\nsame", []),
    ("line number one\nline number two\nthird line here\nin between them\nline number one\nline number two\nthird line here", ["no duplicated seam"]),
]


@pytest.mark.parametrize("text,want", FAULTS)
def test_faults(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert FA.fault_names(FA.fault_details(df)).first()["faults"] == want


def test_first_copy_is_exact():
    def plain(lines):
        for p in range(len(lines) - 3):
            for q in range(p + 3, len(lines) - 2):
                if all(M.similar(lines[p + o], lines[q + o]) > 0.9 for o in range(3)):
                    return [p, q]

    lines = [f"somelinewithnumber{k % 17}init{k % 3}" for k in range(80)]
    assert FA.first_copy(lines) == plain(lines) is not None
    assert FA.first_copy([f"{'abcdefghij'[k % 10] * 12}{k}" for k in range(9)]) is None
    import random

    rng = random.Random(4)
    for _ in range(60):
        base = ["".join(rng.choice("abcd") for _ in range(rng.choice([2, 12, 25]))) for _ in range(9)]
        edit = lambda x: x[: (k := rng.randrange(len(x)))] + rng.choice("abcde") + x[k + 1 :] if rng.random() < 0.5 else x  # noqa: B023, E731
        lines = [edit(x) for x in base + base[rng.randrange(6) :] + base]
        assert FA.first_copy(lines) == plain(lines)


def test_many_lines_are_searched_in_time():
    import random
    import time

    rng, began = random.Random(8), time.time()
    assert FA.first_copy(["".join(rng.choices("etaoinshrdlu", k=40)) for _ in range(3000)]) is None
    assert time.time() - began < 30


def test_run_state(spark):
    rows = [(1, 0, "a", None), (1, 1, None, "failed"), (1, 2, None, None), (2, 0, "b", "truncated")]
    df = spark.createDataFrame(rows, "page long, index int, text string, lapse string")
    assert {r.page: (r.done, r.total, r.next_index) for r in J.progress(df).collect()} == {1: (2, 3, 2), 2: (1, 1, None)}
    assert {r.page: (r.failed, r.truncated, r.lapsed) for r in J.lapse_summary(df).collect()} == {1: (1, 0, "1"), 2: (0, 1, "0")}
    assert {(r.page, r["index"]): r.previous for r in J.previous_text(df).collect()} == {(1, 0): None, (1, 1): "a", (1, 2): None, (2, 0): None}
    placed = J.located(J.section_offsets(J.section_counts(df), F.lit(0)))
    assert sorted((r.nth, r.page, r.within) for r in placed.collect()) == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 2, 0)]
    arrived = spark.createDataFrame([(1, 0, "```\nx\n```"), (9, 9, "y")], "page long, index int, raw string")
    assert sorted((r.page, r["index"], r.text or "") for r in J.accept(df, arrived).collect())[0] == (1, 0, "x")


def test_lapses_and_next_steps(spark):
    plan = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "page long, index int")
    arrived = spark.createDataFrame([(1, 0, "```\nx\n```", None), (1, 1, "half\n\n\n\nof it", "truncated"), (2, 0, None, "failed"), (7, 0, "y", None)], "page long, index int, raw string, lapse string")
    taken = J.accept_lapses(plan, arrived)
    assert sorted(map(str, (tuple(r) for r in taken.collect()))) == sorted(map(str, [(1, 0, "x", None), (1, 1, "half\n\nof it", "truncated"), (1, 2, None, None), (2, 0, None, "failed")]))
    step = J.next_steps(taken).collect()
    assert [(r.page, r["index"]) for r in step] == [(1, 2)] and "```\nhalf\nof it\n```" in step[0].prompt and "3 of 3" in step[0].prompt
    pages = J.merged_pages(taken).withColumn("source", F.lit("s"))
    assert {r.page: (r.sections, r.text) for r in pages.collect()} == {1: (3, "x\n\nhalf\n\nof it"), 2: (1, "")}
    assert [r.text for r in J.text_so_far(pages, F.lit(1)).collect()] == ["x\n\nhalf\n\nof it"]
    done = J.finish(pages, F.lit(1), F.lit("m"), F.lit("t")).first()
    assert [tuple(p) for p in done.pages] == [(1, "x\n\nhalf\n\nof it", 3), (2, "", 1)] and done.source == "s"


def test_cases_and_anchors(spark):
    df = spark.createDataFrame([("alpha",), ("beta",)], "name string")
    assert [r.name for r in FA.cases(df, "et").collect()] == ["beta"] and FA.cases(df, None).count() == 2
    anchors = spark.createDataFrame([(1, "One two"), (2, "one  two!"), (3, "three")], "item_id long, text string")
    assert [tuple(r) for r in R.repeated(anchors).collect()] == [("one two", 2)]


def test_section_png(spark, tmp_path):
    import numpy as np

    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    df = spark.createDataFrame([(bytearray(pixels.tobytes()), 5, 4, 3, 1, 9), (bytearray(pixels.tobytes()), 5, 4, 3, 4, 9)], "data binary, width int, height int, channels int, top int, bottom int")
    rows = I.section_png(df).collect()
    assert rows[1].png is None and rows[1].error and rows[0].error is None
    (tmp_path / "a.png").write_bytes(bytes(rows[0].png))
    back = I.read_images(spark, str(tmp_path)).first()
    assert (back.width, back.height) == (5, 3)
    got = np.frombuffer(back.data, np.uint8).reshape(3, 5, 3)[:, :, ::-1]  # the reader gives blue, green, red
    assert (got == pixels[1:]).all()
    small = I.shrunk(np.full((30, 20, 3), 200, np.uint8), 7, 11)
    assert small.shape == (11, 7, 3) and (small == 200).all()
    assert abs(float(I.shrunk(np.arange(900, dtype=np.uint8).reshape(30, 30, 1), 10, 10).mean()) - float(np.arange(900, dtype=np.uint8).mean())) < 1
    assert I.png(np.zeros((1, 1, 4), np.uint8)).startswith(b"\x89PNG")


def test_probe(spark):
    told = A.probe(spark, "http://h/", lambda url: '{"model_alias":"m","modalities":{"vision":true}}' if url == "http://h/props" else "").first()
    assert tuple(told) == ("m", True, None)
    assert A.probe(spark, "http://127.0.0.1:9").first().error.startswith("unreachable")


def test_prompts(spark):
    df = spark.createDataFrame([(0, 1, None), (0, 3, None), (1, 3, "a\n\nb"), (2, 3, " ")], "i int, n int, p string")
    got = [r[0] for r in df.select(P.for_section(F.col("i"), F.col("n"), F.col("p"))).collect()]
    assert got[0] == P.BASE and "1 of 3" in got[1] and "```\na\nb\n```" in got[2] and "```" not in got[3] and P.BOTTOM in got[3]
    assert spark.range(1).select(X.tail_lines(F.lit("\n".join(map(str, range(30)))), 3)).first()[0] == "27\n28\n29"


def test_rendering(spark, tmp_path):
    one = spark.createDataFrame([(1, 'Q: "1"', "m", "2024-01-01T00:00:00Z", [(1, " a ", 1)]), (2, "s", "m", "t", [(1, "a", 1), (2, "", 1), (3, "b\n", 1)])], f"doc_id long, source string, model string, processed string, pages {RE.PAGES}")
    md = {r.doc_id: r.m for r in one.select("doc_id", RE.markdown().alias("m")).collect()}
    assert md[1] == '---\nsource: "Q: \\"1\\""\nprocessed: 2024-01-01T00:00:00Z\npages: 1\nmodel: "m"\n---\n\na\n'
    assert "## Page 3\n\nb\n" in md[2]
    text = {r.doc_id: r.t for r in one.select("doc_id", RE.plain_text().alias("t")).collect()}
    assert text[1].endswith("\n\na\n") and text[2].endswith("--- Page 3 ---\n\nb\n")
    assert {r.doc_id: r.b for r in one.select("doc_id", RE.body().alias("b")).collect()}[2] == "a\n\nb"
    fmt = F.when(F.col("doc_id") == 1, "markdown").otherwise("text")
    told = RE.save(one.select("doc_id", RE.filename(F.lit("a/b"), fmt).alias("name"), RE.render(fmt).alias("body")), f"file://{tmp_path}/out").collect()
    assert {(r.doc_id, r.name) for r in told} == {(1, "a-b.md"), (2, "a-b.txt")}
    assert (tmp_path / "out" / "1" / "a-b.md").read_text() == md[1] and (tmp_path / "out" / "2" / "a-b.txt").read_text() == text[2]
    assert len(list((tmp_path / "out").rglob("*"))) == 4
    assert len(spark.range(1).select(RE.timestamp(spark)).first()[0]) == 20


def test_library(spark):
    rows = [("f", "", "F", "folder", ""), ("g", "f", "G", "folder", ""), ("d", "g", "b", "document", "pdf"), ("e", "g", "A", "document", ""), ("x", "trash", "X", "folder", ""), ("y", "x", "Y", "document", ""), ("p", "q", "P", "folder", ""), ("q", "p", "Q", "folder", "")]
    df = spark.createDataFrame(rows, "id string, parent string, name string, kind string, file_type string")
    assert {r.id: (r.depth, r.path) for r in LB.walk(df).collect()} == {"f": (0, "F"), "g": (1, "F/G"), "d": (2, "F/G/b"), "e": (2, "F/G/A")}
    chain = [(f"f{k}", f"f{k - 1}" if k else "", "x", "folder", "") for k in range(80)] + [("f3", "f79", "again", "folder", "")]
    deep = LB.walk(spark.createDataFrame(chain, df.schema)).collect()
    assert len(deep) == 81 and max(r.depth for r in deep) == 80
    assert LB.walk(df.limit(0)).count() == 0
    ranked = LB.sorted_rank(df, F.col("parent"))
    assert sorted((r.shelf, r["rank"], r.id) for r in ranked.collect())[:2] == [("g", 1, "e"), ("g", 2, "d")]


def test_images(spark, tmp_path):
    assert I.brightness(bytes([0, 0, 0, 255, 255, 255]), 1, 2, 3) == [0, 255]
    assert I.brightness(bytes([0, 0, 0, 0, 0, 0, 0, 255]), 2, 1, 4) == [127]
    assert I.brightness(bytes([10, 20]), 2, 1, 1) == [15]
    df = spark.createDataFrame([(1, bytearray(range(24)), 2, 4, 3), (2, bytearray(), 0, 0, 3)], "doc_id long, data binary, width int, height int, channels int")
    assert [(r.row, r.brightness) for r in I.profile_rows(df, "doc_id").orderBy("row").collect()] == [(0, 2), (1, 8), (2, 14), (3, 20)]
    c = lambda lo, hi: df.where("doc_id = 1").select(I.crop(F.col("data"), F.col("width"), F.col("height"), F.col("channels"), F.lit(lo), F.lit(hi)).alias("c")).first()["c"]
    assert bytes(c(1, 2)) == bytes(range(6, 12)) and c(5, 9) is None
    (tmp_path / "a.pdf").write_bytes(b"not one")
    assert I.pdf_pages(spark, str(tmp_path), 100).first()["error"] == "not a PDF"


def test_live_answers_are_asked_in_order(spark):
    df = spark.createDataFrame([(1, k, 3, "u") for k in (2, 0, 1)], "page long, index int, total int, url string")

    def ask(body):
        return (None, False, "failed: x") if "#1" in body else (f"got {body}", body.startswith("#2"), None)

    got = A.live(df, ask, lambda i, n, p: f"#{i} after {p}", lambda prompt, url: prompt).orderBy("index").collect()
    assert [(r.text, r.lapse) for r in got] == [("got #0 after None", None), (None, "failed: x"), ("got #2 after None", "truncated")]
    assert A.http("http://127.0.0.1:9", timeout=1)("{}")[2].startswith("failed")


def test_streamed_progress(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "system", "x"), (2, 0, "user", "c" * 301)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = T.answers_of(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "in")))
    got = ST.run_once(spark, ST.page_progress(stream), f"file://{tmp_path}/run")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 2), (2, 1, 1, 301)]
