"""Unified-diff text: parsing, validation, application, trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col, drop_chars, let, lines, rstrip
from millrace.operators.postprocess import close_code, style_stop_words

# Layout of a diff bundle, of hunk headers, and of lines to ignore.
BUNDLE = r"(?s)^<NME> ([^\n]*?)\n<BEF> (.*?)\n<MSG> (.*?)\n<DFF> (.*)$"
HUNK_HEADER = r"(?dm)^(@@ .*? @@).*\n"
LINE_NUMBERS = r"^@@ -(\d*),*?(\d*?) \+(\d*),*?(\d*?) @@"
NO_NEWLINE = r"(?dm)^\\ No newline at end of file$\n?"
FOREIGN_LINE = r"\n[^ +-@]+"
NEW_FILE = "ADDFILE"

VALID = "VALID"
INVALID_TEXT = "INVALID_TEXT"
INVALID_LINE_NUM = "INVALID_LINE_NUM"
INVALID_TEXT_AND_LINE_NUM = "INVALID_TEXT_AND_LINE_NUM"
BAD_FORMAT = "BAD_FORMAT"
BAD_DIFF_HUNK_FORMAT = "BAD_DIFF_HUNK_FORMAT"
BAD_LINE_NUM_FORMAT = "BAD_LINE_NUM_FORMAT"
BAD_HUNK_AND_LINE_FORMAT = "BAD_HUNK_AND_LINE_FORMAT"


def parse_bundle(content: Column | str) -> Column:
    """Struct (name, file, message, diff) of a bundle; null when it is malformed."""
    content = col(content)
    parts = [F.regexp_extract(content, BUNDLE, i).alias(n) for i, n in enumerate(("name", "file", "message", "diff"), 1)]
    return F.when(F.regexp_like(content, F.lit(BUNDLE)), F.struct(*parts))


def without_newline_notes(diff: Column | str) -> Column:
    return F.regexp_replace(col(diff), NO_NEWLINE, "")


def line_numbers(header: Column | str) -> Column:
    """Struct (l1, s1, l2, s2); sizes default to 1, null without both line numbers."""
    header = col(header)
    found = [F.regexp_extract(header, LINE_NUMBERS, i) for i in range(1, 5)]
    number = [F.nullif(f, F.lit("")).try_cast("int") for f in found]
    one = F.lit(1)
    parts = F.struct(
        number[0].alias("l1"),
        F.coalesce(number[1], one).alias("s1"),
        number[2].alias("l2"),
        F.coalesce(number[3], one).alias("s2"),
    )
    return F.when((found[0] != "") & (found[2] != ""), parts)


def hunks(diff: Column | str) -> Column:
    """Array of (header, body).

    Text before the first header shifts the pairing by one, as in the
    scorer this must agree with: that text is then taken for a header.
    """

    def pair(d: Column) -> Column:
        heads = F.regexp_extract_all(d, F.lit(HUNK_HEADER), 1)
        bodies = F.split(d, HUNK_HEADER, -1)

        def zipped(a: Column, b: Column) -> Column:
            return F.zip_with(a, b, lambda h, t: F.struct(h.alias("header"), t.alias("body")))

        n = F.size(heads)
        after = F.slice(bodies, F.lit(2), n)
        ahead = F.slice(bodies, F.lit(1), n)
        return F.when(F.get(bodies, F.lit(0)) == "", zipped(heads, after)).otherwise(zipped(ahead, heads))

    return let(col(diff), pair)


def side_lines(body: Column | str, mark: str) -> Column:
    """Lines of one side of a hunk body without their first character; ``mark`` is - or +."""
    kept = F.filter(lines(body), lambda x: F.left(x, F.lit(1)).isin(" ", mark))
    return F.transform(kept, lambda x: drop_chars(x, 1))


def has_foreign_line(body: Column | str) -> Column:
    """A non-empty line that starts with none of blank, minus, plus."""
    return F.exists(lines(body), lambda x: (x != "") & ~F.left(x, F.lit(1)).isin(" ", "-", "+"))


def parsed_hunks(diff: Column | str) -> Column:
    """Array of (numbers, before, after, foreign), both sides as line arrays."""
    return F.transform(
        hunks(diff),
        lambda h: F.struct(
            line_numbers(h["header"]).alias("numbers"),
            side_lines(h["body"], "-").alias("before"),
            side_lines(h["body"], "+").alias("after"),
            has_foreign_line(h["body"]).alias("foreign"),
        ),
    )


def _text(side: Column) -> Column:
    return F.array_join(side, "\n")


def _text_lines(side: Column) -> Column:
    """Lines of the joined side: an empty side is one empty line."""
    return F.greatest(F.size(side), F.lit(1))


def _new_file_state(found: Column) -> Column:
    one = F.get(found, F.lit(0))
    n = one["numbers"]
    off = (
        (F.size(found) != 1)
        | n.isNull()
        | (n["l1"] != 0)
        | (n["s1"] != 0)
        | (n["l2"] != 1)
    )
    sizes = (n["s2"] != _text_lines(one["after"])) | (_text(one["before"]) != "")
    return (
        F.when(F.coalesce(off, F.lit(True)), F.lit(BAD_LINE_NUM_FORMAT))
        .when(one["foreign"], F.lit(BAD_DIFF_HUNK_FORMAT))
        .when(sizes, F.lit(BAD_LINE_NUM_FORMAT))
        .otherwise(F.lit(VALID))
    )


def _text_missing(file: Column, before: Column) -> Column:
    """The first match of ``before`` is absent or does not end at a line end."""
    at = F.when(before == "", F.lit(1)).otherwise(F.instr(file, before))
    end = at + F.length(before)
    following = F.substring(file, end, F.lit(1))
    return (at == 0) | ((end <= F.length(file)) & (following != "\n"))


def _wrong_numbers(h: Column) -> Column:
    n = h["numbers"]
    off = (n["l1"] <= 0) | (_text_lines(h["before"]) != n["s1"]) | (_text_lines(h["after"]) != n["s2"])
    return F.coalesce(off, F.lit(True))


def diff_state(content: Column | str) -> Column:
    """Validity of a diff bundle, one of the eight states."""

    def judge(bundle: Column) -> Column:
        file = bundle["file"]

        def state(found: Column) -> Column:
            foreign = F.exists(found, lambda h: h["foreign"])
            unnumbered = F.exists(found, lambda h: h["numbers"].isNull())
            no_text = F.exists(found, lambda h: _text_missing(file, _text(h["before"])))
            off = F.exists(found, _wrong_numbers)
            return (
                F.when((file == NEW_FILE) & (F.size(found) > 0), _new_file_state(found))
                .when(foreign & unnumbered, F.lit(BAD_HUNK_AND_LINE_FORMAT))
                .when(foreign, F.lit(BAD_DIFF_HUNK_FORMAT))
                .when(unnumbered, F.lit(BAD_LINE_NUM_FORMAT))
                .when(no_text & off, F.lit(INVALID_TEXT_AND_LINE_NUM))
                .when(no_text, F.lit(INVALID_TEXT))
                .when(off, F.lit(INVALID_LINE_NUM))
                .otherwise(F.lit(VALID))
            )

        return F.when(bundle.isNull(), F.lit(BAD_FORMAT)).otherwise(let(parsed_hunks(bundle["diff"]), state))

    return let(parse_bundle(without_newline_notes(content)), judge)


def state_counts(df: DataFrame, content: Column | str) -> DataFrame:
    return df.groupBy(diff_state(content).alias("state")).agg(F.count("*").alias("diffs"))


def _replace_forward(acc: Column, before: Column, after: Column) -> Column:
    """Replace the next match of ``before`` and move behind it; leave the rest alone."""
    file, ptr = acc["file"], acc["ptr"]
    at = F.call_function("locate", before, file, ptr + 1)
    end = at + F.length(before)
    fits = (at > 0) & ((end > F.length(file)) | (F.substring(file, end, F.lit(1)) == "\n"))
    changed = F.struct(
        F.concat(F.substring(file, F.lit(1), at - 1), after, drop_chars(file, end - 1)).alias("file"),
        (at - 1 + F.length(after)).alias("ptr"),
    )
    return F.when(fits, changed).otherwise(acc)


def _prepend(acc: Column, after: Column) -> Column:
    """A hunk without context can only open the file."""
    opened = F.struct(F.concat(after, F.lit("\n"), acc["file"]).alias("file"), F.lit(1).alias("ptr"))
    return F.when(acc["ptr"] != 0, acc).otherwise(opened)


def apply_diff(file: Column | str, diff: Column | str) -> Column:
    """File after its hunks, matched by text, moving forward; hunks that do not match are skipped."""
    file = col(file)

    def fold(found: Column) -> Column:
        def step(acc: Column, h: Column) -> Column:
            before, after = _text(h["before"]), _text(h["after"])
            return F.when(before == "", _prepend(acc, after)).otherwise(_replace_forward(acc, before, after))

        start = F.struct(file.alias("file"), F.lit(0).alias("ptr"))
        folded = F.aggregate(found, start, step, lambda acc: acc["file"])
        first = F.get(found, F.lit(0))
        return F.when((file == NEW_FILE) & (F.size(found) > 0), _text(first["after"])).otherwise(folded)

    return let(parsed_hunks(without_newline_notes(diff)), fold)


def apply_diff_by_number(file: Column | str, diff: Column | str) -> Column:
    """File after its hunks, placed by their line numbers; hunks whose lines differ are skipped."""
    file = col(file)

    def step(acc: Column, h: Column) -> Column:
        n, before, after, body = h["numbers"], h["before"], h["after"], acc["lines"]
        at = n["l1"] + acc["shift"]
        referred = F.slice(body, F.greatest(at, F.lit(1)), n["s1"])
        same = F.forall(
            F.zip_with(before, referred, lambda a, b: F.coalesce(a == b, F.lit(True))), lambda ok: ok
        )
        tail = at - 1 + n["s1"]
        inside = F.flatten(
            F.array(
                F.slice(body, F.lit(1), F.greatest(at - 1, F.lit(0))),
                after,
                F.slice(body, F.greatest(tail + 1, F.lit(1)), F.greatest(F.size(body) - tail, F.lit(0))),
            )
        )
        placed = F.when(at == 0, F.concat(after, body)).otherwise(inside)
        moved = F.struct(placed.alias("lines"), (acc["shift"] + F.size(after) - n["s1"]).alias("shift"))
        usable = n.isNotNull() & (F.size(before) == n["s1"]) & (at >= 0) & ((at == 0) | same)
        return F.when(F.coalesce(usable, F.lit(False)), moved).otherwise(acc)

    def fold(found: Column) -> Column:
        start = F.struct(lines(file).alias("lines"), F.lit(0).alias("shift"))
        folded = F.aggregate(found, start, step, lambda acc: F.array_join(acc["lines"], "\n"))
        return F.when((file == NEW_FILE) & (F.size(found) > 0), F.lit("")).otherwise(folded)

    return let(parsed_hunks(without_newline_notes(diff)), fold)


def fixed_code(buggy: Column | str, diff: Column | str) -> Column:
    """Buggy code with a candidate diff applied; an empty or missing diff gives empty code."""
    diff = F.coalesce(col(diff), F.lit(""))
    return F.when(diff == "", F.lit("")).otherwise(apply_diff(buggy, diff))


def trimmed_diff(generation: Column | str) -> Column:
    """Diff part of a generated bundle up to the first foreign line or a new bundle; null if unparsable."""
    diff = parse_bundle(generation)["diff"]
    own = F.get(F.split(diff, FOREIGN_LINE, -1), F.lit(0))
    return F.substring_index(own, "<NME>", 1)


def fix_generation(
    style: str, language: str, generation: Column | str, prompt: Column | str, prompt_base: Column | str
) -> Column:
    """Scorable text of a bug-fix generation in a prompt style.

    What follows the prompt is cut at the style's stop words and closed by
    language.  Plain styles put it behind the base of the prompt, ``diff`` takes
    it as it is, and ``diff-carper`` parses it with its prompt as a bundle.
    """
    own = rstrip(drop_chars(generation, F.length(col(prompt))))
    closed = let(own, lambda g: close_code(g, language, style_stop_words(language, style)))
    if style == "diff-carper":
        return let(F.concat(col(prompt), closed), trimmed_diff)
    return closed if style.startswith("diff") else F.concat(rstrip(prompt_base), closed)
