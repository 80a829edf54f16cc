"""Behaviour of the column functions on our own strings."""

from __future__ import annotations

import pytest
import regex
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as X
from quire.functions import wire as V
from quire.sources import tables as T


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\rb", ["a\rb"])])
def test_lines(one, text, want):
    assert one(X.lines(F.lit(text))) == want


@pytest.mark.parametrize("raw,want", [
    ("```markdown\nhello\n```", "hello"), ("```\nopen fence\nrest", "open fence\nrest"), ("one line ```", "one line ```"), ("```", "```"),
    ("    a\n      b\n    c", "a\n  b\nc"), ("a  b   c", "a b c"), ("\n\na\n\n\n\nb\n\n", "a\n\nb"), ("  x\n\ty", " x\ny"), ("a \t\nb", "a\nb"), ("", ""), (None, ""),
    ("text\n```\ncode\n```", "text\n```\ncode\n```"),
])
def test_clean(one, raw, want):
    assert one(X.clean(F.lit(raw))) == want


def test_clean_is_idempotent(one):
    raw = "```\n   - a  b\n\n\n     - c \n```"
    assert one(X.clean(F.lit(raw))) == one(X.clean(X.clean(F.lit(raw)))) == "- a b\n\n  - c"


@pytest.mark.parametrize("raw,want", [
    ("body\n---UNCERTAIN---\n- word\n* none\n• NONE\n\n" + "x" * 49, ["word"]), ("no footer", []), ("a---UNCERTAIN---b---UNCERTAIN---", ["b---UNCERTAIN---"]), (None, []),
])
def test_doubts(one, raw, want):
    assert one(X.doubts(F.lit(raw))) == want


def test_footer_body(one):
    assert one(X.footer_body(F.lit("body\n---UNCERTAIN---\nx\n---UNCERTAIN---"))) == "body\n"


@pytest.mark.parametrize("text,doubts,want", [
    ("cat concat cat.", ["cat"], "[unclear: cat] concat [unclear: cat]."),
    ("a b", ["a"], "a b"), ("an [unclear: owl] owl", ["owl"], "an [unclear: owl] [unclear: owl]"),
    ("big cat", ["big cat", "cat"], "[unclear: big cat]"), ("x.y xzy", ["x.y"], "[unclear: x.y] xzy"), ("naïve naïveté", ["naïve"], "[unclear: naïve] naïveté"), (r"a\Eb\Q x\E", [r"a\Eb", r"x\E"], r"[unclear: a\Eb]\Q [unclear: x\E]"),
])
def test_mark_doubts(one, text, doubts, want):
    assert one(X.mark_doubts(F.lit(text), F.array(*map(F.lit, doubts)))) == want


def plainly_marked(text, doubts):
    """Each doubt in turn, over the parts of the text that are no marks, letter by letter."""
    word = lambda part, at: 0 <= at < len(part) and regex.match(r"[\p{Alphabetic}\p{N}_]", part[at])
    parts, at = [], 0
    for m in regex.finditer(r"\[unclear:[^\]]*\]?", text):
        parts, at = [*parts, (False, text[at : m.start()]), (True, m[0])], m.end()
    parts.append((False, text[at:]))
    for d in doubts:
        if len(d) < 2 or "unclear" in d:
            continue
        after = []
        for mark, part in parts:
            begin = at = 0
            while not mark and at < len(part):
                if part.startswith(d, at) and not word(part, at - 1) and not word(part, at + len(d)):
                    after += [(False, part[begin:at]), (True, f"[unclear: {d}]")]
                    begin = at = at + len(d)
                else:
                    at += 1
            after.append((mark, part[begin:]))
        parts = after
    return "".join(x for _, x in parts)


def test_mark_doubts_of_whole_table(spark):
    """All answers derived from the documents, with their own doubts and with long lists that repeat and overlap."""
    from quire.plans import catalog

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    raws = T.raw_answers(docs)
    body = X.clean(X.footer_body("raw"))
    words = F.array_distinct(F.split(X.footer_body("raw"), r"\s+"))
    two = F.transform(F.slice(words, 1, 30), lambda w, i: F.concat_ws(" ", F.get(words, i + 1), w))
    many = F.concat(two, F.slice(words, 3, 60), two, F.array(F.lit("absent"), F.lit("a"), F.lit("unclear"), F.lit("..")))
    got = raws.select("doc_id", body.alias("body"), X.doubts("raw").alias("own"), many.alias("many"), X.mark_doubts(body, many).alias("marked")).collect()
    asked = {r.doc_id: r for r in catalog.QUERIES["mark_doubts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(asked) == docs.count() and sum(r.marks for r in asked.values()) > 0
    for r in got:
        assert r.marked == plainly_marked(r.body, r.many)
        assert asked[r.doc_id].text == plainly_marked(r.body, r.own) and asked[r.doc_id].marks == asked[r.doc_id].text.count("[unclear:")


def test_flatten_and_normalise(one):
    assert one(X.flatten(F.lit("A-B  [unclear: Cé] 9!"))) == "a b cé 9"
    assert one(X.normalise(F.lit("- A b_C 9."))) == "abc9"
    assert one(X.normalise(F.lit("ΟΔΟΣ ς"))) == "οδοσς" and one(X.normalise(F.lit("हिन्दी"))) == "हिनदी"


@pytest.mark.parametrize("line,bullet,rule", [("- a", True, False), ("  * a", True, False), ("12. a", True, False), (". a", True, False), ("-a", False, False), (" --- ", False, True), ("--", False, False), ("a. b", False, False)])
def test_line_kinds(one, line, bullet, rule):
    assert one(X.is_bullet(F.lit(line))) == bullet and one(X.is_rule(F.lit(line))) == rule


@pytest.mark.parametrize("a,b,want", [("", "", 1.0), ("", "x", 0.0), ("---", "***", 1.0), ("A b", "ab", 1.0), ("a", "b", 0.0), ("night", "nacht", 0.25), ("ooo", "ooooooo", 4 / 8)])
def test_similarity(one, a, b, want):
    assert one(X.similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("name,want", [("May/June list", "May-June list"), ("..a..", "a"), ("...", "Untitled"), ("a\tb", "a b"), (None, "Untitled"), ("a\\b\x01c", "a-b c")])
def test_safe_filename(one, name, want):
    assert one(X.safe_filename(F.lit(name))) == want


def test_blank_pages_and_urls(one):
    assert one(X.is_blank_page(F.lit(" [Blank Page] "))) and not one(X.is_blank_page(F.lit("[a]")))
    assert one(X.base_url(F.lit(" http://h:1// "))) == "http://h:1"
    assert one(X.json_string(F.lit('a"b\n'))) == '"a\\"b\\n"'
    assert [one(X.valid_id(F.lit(x))) for x in ("a-b_9", "", "../x", "a/b", "x" * 65, "a b", "a\n")] == [True] + [False] * 6


def test_layout(one):
    assert one(L.max_section_height(F.lit(1620))) == 2267
    assert one(L.render_width(F.lit(1.4))) == 1667
    assert one(L.section_count(F.lit(2160), F.lit(2267))) == 1
    assert [one(L.section_count(F.lit(h), F.lit(2267))) for h in (9176, 17002)] == [6, 11]
    assert one(L.budget_size(F.lit(100), F.lit(100)))[:] == (100, 100)
    w, h = one(L.budget_size(F.lit(3240), F.lit(4588)))
    assert w * h <= L.PIXEL_BUDGET and abs(w / h - 3240 / 4588) < 1e-3


def test_sections_keep_their_ceiling(spark):
    rows = spark.range(1, 400).select((F.col("id") * 37).cast("int").alias("height")).withColumn("runs", F.transform(F.sequence(F.lit(1), F.greatest((F.col("height") / 120).cast("int"), F.lit(1))), lambda k: F.struct((k * 113).alias("start"), (k * 113 + 6).alias("end"))))
    cut = rows.withColumn("s", L.sections(L.cut_points(F.col("runs"), F.col("height"), F.lit(1000)), F.col("height"), F.lit(1000)))
    for r in cut.collect():
        assert all(s.top < s.bottom and s.bottom - s.top <= 1000 for s in r.s) if len(r.s) < 64 and len(r.s) > 1 else True
        assert [s.top for s in r.s] == sorted(s.top for s in r.s) and r.s[0].top == 0 and r.s[-1].bottom == r.height


def test_listing(one):
    body = '[{"ID":"a","VissibleName":" ","VisibleName":"x","Type":"CollectionType"},{"ID":""},{"ID":"b","VisibleName":"B","Parent":"trash","fileType":"pdf"}]'
    assert [tuple(x) for x in one(V.listing_items(F.lit(body)))] == [("a", "Untitled", "folder", "", ""), ("b", "B", "document", "trash", "pdf")]
    assert one(V.listing_items(F.lit("[]"))) == [] and one(V.listing_items(F.lit('{"ID":"a"}'))) is None and one(V.listing_items(F.lit("no"))) is None


def test_server_answers(one):
    assert one(V.server_model(F.lit('{"model_path":"/m/q.gguf.gguf"}'))) == "q" and one(V.server_model(F.lit("x"))) is None
    assert one(V.server_vision(F.lit('{"modalities":{"vision":true}}'))) and not one(V.server_vision(F.lit("{}")))
    assert tuple(one(V.completion(F.lit('{"choices":[{"message":{"content":"t"},"finish_reason":"length"}]}')))) == ("t", True, None)
    assert [one(V.completion(F.lit(x)))["error"] for x in ('{"choices":[]}', '{"choices":[{}]}', "<html>")] == ["no completion", "no content", "unreadable"]


def test_page_numbers(one):
    assert [one(V.page_number(F.lit(x))) for x in ("/a-1/p-07.png", "p-12.png", "p.png", "p-x.png")] == [7, 12, None, None]
    assert one(V.page_count(F.lit("Title: a\nPages:          12\nx"))) == 12 and one(V.page_count(F.lit("Pages: many"))) is None
    assert one(V.page_count_command(F.lit("a b.pdf"))) == ["pdfinfo", "a b.pdf"]
    assert one(V.data_url(F.lit(b"foo")))[-4:] == "Zm9v" and one(V.download_path(F.lit("../x"))) is None
    assert one(V.is_pdf(F.lit(b"%PDF-1.4"))) and not one(V.is_pdf(F.lit(b"PDF")))
