"""Column functions on raw answers and lines of text.

All are built-in expressions. White space is Unicode's, lengths named ``bytes`` are of UTF-8, and a null text counts
as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the answer format.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FOOTER_MARKER = "---UNCERTAIN---"
NOTHING_DOUBTED = "none"
LONGEST_DOUBT_BYTES = 48
BLANK_MARKERS = ("[blank page]", "[blank]", "[empty]", "[no text]", "[no text detected]")
UNCLEAR = "[unclear:"
ALNUM = r"\p{IsAlphabetic}\p{N}"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def is_empty(c: Column) -> Column:
    """Nothing but white space."""
    return trim(c) == ""


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    ended = lambda x, end: F.when(x.endswith(end), F.substr(x, F.lit(1), F.length(x) - len(end))).otherwise(x)
    parts = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(ended(t, "\n"), "\n"), lambda x: ended(x, "\r")))
    return let(text_of(c), parts)


def indent_bytes(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(trim_start(line))


def common_indent(ls: Column) -> Column:
    """The least indent in bytes of the lines that aren't blank; 0 if all are."""
    return F.coalesce(F.array_min(F.transform(F.filter(ls, lambda x: ~is_empty(x)), indent_bytes)), F.lit(0))


def strip_fence(c: Column) -> Column:
    """The body of a text that opens with a fence: without the first line, and without a fence at the very end."""
    body = F.regexp_replace(c, r"\A[^\n]*\n", "")
    unclosed = F.regexp_replace(body, rf"```{WS}*\z", "")
    return F.when(c.startswith("```") & c.contains("\n"), unclosed).otherwise(c)


def collapse_spaces(line: Column) -> Column:
    """Squeeze runs of spaces behind the indent."""
    head = F.regexp_extract(line, rf"\A({WS}*)", 1)
    return F.concat(head, F.regexp_replace(F.substr(line, F.length(head) + 1), " {2,}", " "))


def clean(c: Column | str) -> Column:
    """A raw answer without fence, common indent, line-end spaces, runs of blank lines and of spaces."""
    body = let(text_of(c), lambda raw: let(trim(raw), lambda t: F.when(t.startswith("```"), strip_fence(t)).otherwise(raw)))

    def tidy(ls: Column) -> Column:
        return let(common_indent(ls), lambda n: let(F.transform(ls, trim_end), lambda ts: F.filter(
            F.transform(ts, lambda t, i: F.when((t == "") & (F.coalesce(F.get(ts, i - 1), F.lit("")) == ""), F.lit(None)).otherwise(
                F.when(t == "", t).otherwise(collapse_spaces(F.substr(t, F.least(n, indent_bytes(t)) + 1))))),
            lambda x: x.isNotNull(),
        )))

    return let(lines(body), lambda ls: F.regexp_replace(F.array_join(tidy(ls), "\n"), r"\A\n+|\n+\z", ""))


def footer_body(c: Column | str) -> Column:
    """What stands before the first footer marker."""
    return F.split_part(text_of(c), F.lit(FOOTER_MARKER), F.lit(1))


def doubts(c: Column | str) -> Column:
    """The doubted words that the footer lists, in order."""
    raw = text_of(c)
    after = F.when(raw.contains(FOOTER_MARKER), F.substr(raw, F.locate(FOOTER_MARKER, raw) + len(FOOTER_MARKER))).otherwise(F.lit(""))
    item = lambda x: trim(F.regexp_replace(trim(x), r"\A[-*• ]+", ""))
    return F.filter(F.transform(lines(after), item), lambda x: (x != "") & (F.lower(x) != NOTHING_DOUBTED) & (F.octet_length(x) <= LONGEST_DOUBT_BYTES))


def mark_doubts(c: Column, found: Column) -> Column:
    """Wrap each whole word that is doubted, unless it is marked: words are neither split nor nested.

    The text is cut at existing marks; only the parts between them are searched. A doubt that the text doesn't hold can't
    match later either, as marks only cut the text, so each is looked up plainly and only those found are
    searched as words, in their order; a doubt listed twice may match beside a mark that came between.
    """
    quoted = lambda d: F.concat(F.lit(r"\[unclear:[^\]]*\]?|(?<![" + ALNUM + r"_])(\Q"), F.replace(d, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)(?![" + ALNUM + r"_])"))

    def one(text: Column, d: Column) -> Column:
        hits = F.regexp_extract_all(text, quoted(d), F.lit(0))
        marked = F.transform(hits, lambda h: F.when(h.startswith(UNCLEAR), h).otherwise(F.concat(F.lit("[unclear: "), h, F.lit("]"))))
        between = F.split(text, quoted(d), F.lit(-1))
        joined = F.array_join(F.flatten(F.zip_with(between, marked, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        return F.when(F.size(hits) == 0, text).otherwise(joined)

    fits = lambda text: F.filter(found, lambda d: (F.length(d) >= 2) & ~d.contains("unclear") & text.contains(d))
    return let(c, lambda text: F.aggregate(fits(text), text, one))


def transcribed(c: Column | str) -> Column:
    """An answer's cleaned body with its doubts marked."""
    return mark_doubts(clean(footer_body(c)), doubts(c))


def lower(c: Column) -> Column:
    """Lower case of each character by itself: a capital sigma at a word's end is no final one."""
    return F.lower(F.translate(c, "Σ", "σ"))


def flatten(c: Column | str) -> Column:
    """Letters and digits in lower case, all else one space; marks count as their words."""
    plain = F.replace(text_of(c), F.lit(UNCLEAR), F.lit(" "))
    return F.trim(lower(F.regexp_replace(plain, f"[^{ALNUM}]+", " ")))


def normalise(line: Column) -> Column:
    return lower(F.regexp_replace(line, f"[^{ALNUM}]", ""))


def is_blank_page(c: Column | str) -> Column:
    t = F.lower(trim(text_of(c)))
    return (t == "") | t.isin(*BLANK_MARKERS)


def is_bullet(line: Column) -> Column:
    return line.rlike(rf"\A{WS}*(?:[-*] |[0-9]*\. )")


def is_rule(line: Column) -> Column:
    return line.rlike(rf"\A{WS}*-{{3,}}{WS}*\z")


def unclear_count(c: Column | str) -> Column:
    return ((F.length(text_of(c)) - F.length(F.replace(text_of(c), F.lit(UNCLEAR), F.lit("")))) / len(UNCLEAR)).cast("long")


def tail_lines(c: Column | str, n: int = 10) -> Column:
    """The last ``n`` lines that aren't blank; null if there is none."""
    return let(F.filter(lines(c), lambda x: ~is_empty(x)), lambda ls: F.when(F.size(ls) > 0, F.array_join(F.slice(ls, F.greatest(F.size(ls) - n + 1, F.lit(1)), n), "\n")))


def bigrams(word: Column, pair=F.concat) -> Column:
    """Neighbouring pairs of characters, each as ``pair`` of the two; the characters are cut once, as ``substr`` counts
    them from the start."""
    none = F.array().cast("array<string>" if pair is F.concat else "array<bigint>")
    pairs = lambda cs: F.zip_with(F.slice(cs, 1, F.greatest(F.size(cs) - 1, F.lit(0))), F.slice(cs, 2, F.greatest(F.size(cs) - 1, F.lit(0))), lambda x, y: pair(x, y))
    return F.when(F.length(word) < 2, none).otherwise(let(F.split(word, ""), pairs))


def grams(line: Column) -> Column:
    """(normal, grams) of a line: its bigrams, each hashed with the number of its occurrence, so that sets act as multisets."""
    def numbered(s: Column) -> Column:
        ends = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
        return let(ends, lambda e: F.flatten(F.transform(e, lambda at, k: F.transform(F.sequence(F.lit(1), at - F.coalesce(F.get(e, k - 1), F.lit(-1))), lambda c: F.xxhash64(F.get(s, at), c)))))

    return let(normalise(line), lambda n: F.struct(n.alias("normal"), let(F.sort_array(bigrams(n, F.xxhash64)), numbered).alias("grams")))


def dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of two ``grams``, 0 to 1: equal normal forms are alike, shorter ones than a bigram are not."""
    shared = F.size(F.array_intersect(a["grams"], b["grams"]))
    return F.when(a["normal"] == b["normal"], F.lit(1.0)).when((F.size(a["grams"]) == 0) | (F.size(b["grams"]) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * shared / (F.size(a["grams"]) + F.size(b["grams"])))


def similarity(a: Column, b: Column) -> Column:
    """Of two lines; where many pairs of few lines are compared, take ``grams`` of each line first."""
    return let(F.struct(grams(a).alias("a"), grams(b).alias("b")), lambda p: dice(p["a"], p["b"]))


def safe_filename(c: Column | str) -> Column:
    t = F.regexp_replace(F.translate(text_of(c), "/\\\x00", "---"), r"[\x01-\x1f\x7f-\x9f]", " ")
    t = trim(F.regexp_replace(trim(t), r"\A\.+|\.+\z", ""))
    return F.when(t == "", F.lit("Untitled")).otherwise(t)


def json_string(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", "$1")


def valid_id(c: Column | str) -> Column:
    return text_of(c).rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def base_url(c: Column | str) -> Column:
    return F.regexp_replace(trim(text_of(c)), r"/+\z", "")
