"""From raw generations to text that can be scored or run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col, drop_chars, let, lines, literal_pattern, lstrip, rstrip, strip, take_chars
from millrace.operators.prompts import INFILL_MARKS, QUOTES

# Stop words by language.
STOP_WORDS = {
    "python": ("\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif", "\nassert"),
    "go": ("\n//", "\nfunc main(", "struct", "\nfunc"),
}
END_OF_TEXT = "<|endoftext|>"
# Stop words by prompt style.
COMMIT_MARKS = ("<commit_before>", "<commit_msg>", "<commit_after>")
CHAT_END = "<|end|>"
BUNDLE_MARKS = ("<BEF>", "<MSG>", "<DFF>", "\\ No newline at end of file")
OPEN_BRACES = {"java": 2, "js": 1, "go": 1, "cpp": 1, "rust": 1}

# Imports put before a candidate.
PYTHON_IMPORTS = (
    "import math",
    "import re",
    "import sys",
    "import copy",
    "import datetime",
    "import itertools",
    "import collections",
    "import heapq",
    "import statistics",
    "import functools",
    "import hashlib",
    "import numpy",
    "import numpy as np",
    "import string",
    "from typing import *",
    "from collections import *",
)
CPP_IMPORTS = (
    "using namespace std;",
    "#include<stdlib.h>",
    "#include<algorithm>",
    "#include<cmath>",
    "#include<math.h>",
    "#include<numeric>",
    "#include<stdio.h>",
    "#include<vector>",
    "#include<set>",
    "#include<map>",
    "#include<queue>",
    "#include<stack>",
    "#include<list>",
    "#include<deque>",
    "#include<boost/any.hpp>",
    "#include<string>",
    "#include<climits>",
    "#include<cstring>",
    "#include<iostream>",
    "#include<sstream>",
    "#include<fstream>",
)
GO_PACKAGES = ("math", "strings", "fmt", "strconv", "time", "bytes", "regexp", "sort", "math/rand", "crypto/md5")


def stop_words(language: str, extra: Sequence[str] = ()) -> tuple[str, ...]:
    return (*STOP_WORDS.get(language, ()), *extra, END_OF_TEXT)


def style_stop_words(language: str, style: str) -> tuple[str, ...]:
    """Stop words of a prompt style; the diff styles have their own instead of the language's."""
    if style == "diff":
        return (*COMMIT_MARKS, END_OF_TEXT)
    if style == "diff-carper":
        return (*BUNDLE_MARKS, END_OF_TEXT)
    if style.startswith("edit"):
        return stop_words(language, COMMIT_MARKS)
    return stop_words(language, (CHAT_END,) if style == "starchat" else ())


def cut_at_stop(text: Column | str, stops: Sequence[str]) -> Column:
    """Text before the earliest of the stop words; all of it if none occurs."""
    text = col(text)
    if not stops:
        return text
    found = F.array(*[F.nullif(F.instr(text, F.lit(s)), F.lit(0)) for s in stops])
    first = F.array_min(found)
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def cut_in_turn(text: Column | str, stops: Sequence[str]) -> Column:
    """Cut at the first occurrence of each stop word, one word after the other."""
    return reduce(lambda t, s: F.substring_index(t, s, 1), stops, col(text))


def complete_after_prompt(generation: Column | str, prompt: Column | str, stops: Sequence[str]) -> Column:
    """Prompt followed by the generation's own part up to a stop word."""
    return F.concat(col(prompt), cut_at_stop(drop_chars(generation, F.length(col(prompt))), stops))


def drop_prefix(text: Column | str, prefix: str) -> Column:
    text = col(text)
    return F.when(F.startswith(text, F.lit(prefix)), drop_chars(text, len(prefix))).otherwise(text)


def clean_generation(
    text: Column | str, bos: str = "", tokenizer_prefix: str = "", run_prefix: str = "", keep_run_prefix: bool = False
) -> Column:
    """Without the begin token, the tokenizer's own prefix, and the run's prefix."""
    out = drop_prefix(text, bos) if bos else col(text)
    if tokenizer_prefix:
        out = F.when(
            F.startswith(out, F.lit(tokenizer_prefix)), lstrip(drop_chars(out, len(tokenizer_prefix)))
        ).otherwise(out)
    return out if keep_run_prefix else drop_chars(out, len(run_prefix))


def infilled_middle(model: str, text: Column | str, special_tokens: Sequence[str] = ()) -> Column:
    """The infilled part of a generation, without special tokens."""
    if model not in INFILL_MARKS:
        raise ValueError(f"infilling is not supported for {model!r}")
    first, second, third = INFILL_MARKS[model]
    end = END_OF_TEXT if first else "<|endofmask|>"
    after = drop_chars(text, F.instr(col(text), F.lit(second)) - 1 + len(second))
    middle = drop_chars(after, F.instr(after, F.lit(third)) - 1 + len(third))
    out = F.substring_index(middle, end, 1)
    for token in special_tokens:
        out = F.replace(out, F.lit(token), F.lit(""))
    return out


def after_assistant(text: Column | str, marks: tuple[str, str, str]) -> Column:
    """Text after the assistant mark; unchanged when it is missing."""
    _, end, assistant = marks
    mark = assistant or end
    if not mark:
        return col(text)
    text = col(text)
    at = F.instr(text, F.lit(mark))
    if "```python" in mark:
        fence = F.call_function("locate", F.lit("```python"), text, at)
        rest = drop_chars(text, fence - 1 + len("```python"))
    else:
        rest = drop_chars(text, at - 1 + len(mark))
    return F.when(at > 0, rest).otherwise(text)


def _unindented(line: Column) -> Column:
    """A line with text that starts at the margin (blank or tab are indents)."""
    return (strip(line) != "") & ~F.left(line, F.lit(1)).isin(" ", "\t")


def first_position(flags: Column) -> Column:
    """1-based position of the first true entry, 0 if there is none."""
    return F.array_position(flags, True)


def before_second_margin(code: Column | str) -> Column:
    """Everything before the first unindented line after the first non-empty one."""
    code = col(code)
    parts = lines(code)
    opening = first_position(F.transform(parts, lambda x: x != ""))
    later = F.transform(
        parts, lambda x, i: (i >= opening) & F.regexp_like(x, F.lit(r"(?U)^[^\s\x{1c}-\x{1f}]"))
    )
    at = first_position(later)
    head = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), "\n"), F.lit("\n"))
    return F.when((opening > 0) & (at > 0), head).otherwise(code)


def drop_last_block(text: Column | str, stops: Sequence[str]) -> Column:
    """Text before the last stop word; empty when there is none."""
    text = col(text)
    pattern = "(" + "|".join(literal_pattern(s) for s in stops) + ")"
    marks = F.regexp_extract_all(text, F.lit(pattern), 1)
    tail = F.length(F.element_at(F.split(text, pattern, -1), -1)) + F.length(F.get(marks, F.size(marks) - 1))
    return F.when(F.size(marks) > 0, F.substring(text, F.lit(1), F.length(text) - tail)).otherwise(F.lit(""))


def _close_python(code: Column) -> Column:
    parts = lines(code)
    at = first_position(F.transform(parts, _unindented))
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), "\n")
    return F.when(at > 0, head).otherwise(code)


def balanced_length(code: Column | str, opened: int) -> Column:
    """Characters up to the brace that closes ``opened`` open ones; 0 if none does.

    Folds over the pieces between closing braces, not over characters.
    """
    code = col(code)
    pieces = F.split(code, "\\}", -1)
    start = F.struct(
        F.lit(opened).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("cut")
    )

    def step(acc: Column, piece: Column) -> Column:
        opens = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = acc["depth"] + opens - 1
        seen = acc["seen"] + F.length(piece) + 1
        return F.struct(
            depth.alias("depth"),
            seen.alias("seen"),
            F.when(acc["cut"] > 0, acc["cut"]).when(depth == 0, seen).otherwise(F.lit(0)).alias("cut"),
        )

    closing = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.aggregate(closing, start, step, lambda acc: acc["cut"])


def _to_last_brace(code: Column) -> Column:
    """Text through the last closing brace; unchanged without one."""
    tail = F.length(F.element_at(F.split(code, "\\}", -1), -1))
    return F.when(F.contains(code, F.lit("}")), F.substring(code, F.lit(1), F.length(code) - tail)).otherwise(code)


def _count(code: Column, char: str) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit(char), F.lit("")))


def _close_java(code: Column) -> Column:
    """Fallback for unclosed Java: without main, through the last brace, one brace added if one is missing."""
    main = "public static void main"
    cut = F.when(
        F.contains(code, F.lit(main)), F.concat(F.substring_index(code, main, 1), F.lit("}"))
    ).otherwise(code)
    return let(
        let(cut, _to_last_brace),
        lambda t: F.when(_count(t, "{") - 1 == _count(t, "}"), F.concat(t, F.lit("\n}"))).otherwise(t),
    )


def close_code(code: Column | str, language: str, stops: Sequence[str] | None = None) -> Column:
    """Cut a completion where its function ends.

    Python ends before the first unindented line; brace languages end where
    the braces opened by the prompt are closed, or at the last brace.
    """
    cut = cut_in_turn(code, stop_words(language) if stops is None else stops)
    if language == "python":
        return let(cut, _close_python)
    if language not in OPEN_BRACES:
        return cut
    fallback = _close_java if language == "java" else _to_last_brace

    def close(text: Column) -> Column:
        size = balanced_length(text, OPEN_BRACES[language])
        return let(size, lambda n: F.when(n > 0, F.substring(text, F.lit(1), n)).otherwise(fallback(text)))

    return let(cut, close)


def first_margin_line(generation: Column | str) -> Column:
    """Python completions through their first unindented line."""
    parts = lines(generation)
    at = first_position(F.transform(parts, _unindented))
    head = F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "\n")
    return F.when(at > 0, head).otherwise(col(generation))


def packed_completion(
    generation: Column | str, prompt: Column | str, language: str, stops: Sequence[str] | None = None
) -> Column:
    """Prompt plus the completion cut at stop words and closed by language."""
    stops = stop_words(language) if stops is None else stops
    own = let(drop_chars(generation, F.length(col(prompt))), lambda g: cut_at_stop(g, stops))
    if language == "python":
        own = let(own, first_margin_line)
    return F.concat(col(prompt), let(rstrip(own), lambda g: close_code(g, language, stops)))


def drop_solution_lines(text: Column | str, solution: Column | str, longer_than: int = 20) -> Column:
    """Text without the solution's longer lines."""

    def without(acc: Column, line: Column) -> Column:
        return F.when(F.length(line) > longer_than, F.replace(acc, line, F.lit(""))).otherwise(acc)

    return F.aggregate(F.transform(lines(solution), strip), col(text), without)


def description(
    generation: Column | str,
    prompt: Column | str,
    docstring: Column | str,
    solution: Column | str,
    stops: Sequence[str] = (END_OF_TEXT,),
) -> Column:
    """Generated description: as long as the docstring at most, without code copied from the solution."""
    own = strip(drop_chars(generation, F.length(col(prompt))))
    head = take_chars(own, F.length(col(docstring)))
    return drop_solution_lines(rstrip(cut_in_turn(head, stops)), solution)


def first_line_after(generation: Column | str, delimiter: str) -> Column:
    """First line of the text between the first and second delimiter; null without one."""
    parts = F.split(col(generation), literal_pattern(delimiter), -1)
    return F.substring_index(strip(F.get(parts, F.lit(1))), "\n", 1)


def quoted_first_line(generation: Column | str) -> Column:
    """First line, or the first line inside each kind of triple quotes that occurs."""

    def first_line(t: Column) -> Column:
        return strip(F.substring_index(strip(t), "\n", 1))

    rest, out = col(generation), first_line(col(generation))
    for quote in QUOTES:
        found = F.contains(rest, F.lit(quote))
        inside = drop_chars(rest, F.instr(rest, F.lit(quote)) - 1 + len(quote))
        out = F.when(found, F.substring_index(first_line(inside), quote, 1)).otherwise(out)
        rest = F.when(found, inside).otherwise(rest)
    return out


def runnable_python(code: Column | str) -> Column:
    return strip(F.concat(F.lit("\n".join(PYTHON_IMPORTS) + "\n"), col(code)))


def runnable_cpp(code: Column | str) -> Column:
    """Includes first; a main function and what follows is cut off."""
    return strip(F.concat(F.lit("\n".join(CPP_IMPORTS) + "\n"), F.substring_index(col(code), "int main", 1)))


def runnable_java(code: Column | str) -> Column:
    return strip(F.replace(col(code), F.lit("public class Main {\n    }"), F.lit("")))


def runnable_rust(code: Column | str, declaration: Column | str) -> Column:
    """Declaration lines the code lacks are put first, and a second main is cut off."""
    code = col(code)
    main = "fn main()"
    stripped = F.transform(lines(declaration), strip)
    missing = F.filter(
        stripped,
        lambda x: ~F.contains(code, x)
        & ~(F.startswith(x, F.lit("fn")) & F.contains(code, F.substring_index(x, "(", 1))),
    )
    head = F.array_join(F.transform(missing, lambda x: F.concat(x, F.lit("\n"))), "")
    opening = F.when(F.contains(code, F.lit(main)), F.lit("")).otherwise(F.lit("fn main(){}\n"))
    return F.concat(opening, head, F.substring_index(code, main, 2))


def unused_setup(setup: Column | str, code: Column | str) -> Column:
    """Go test setup without the imports the code already has."""

    def without(acc: Column, line: Column) -> Column:
        bare = line
        for word in ("import", "(", ")"):
            bare = F.replace(bare, F.lit(word), F.lit(""))
        bare = strip(bare)
        known = F.startswith(bare, F.lit('"')) & F.contains(col(code), bare)
        return F.when(known, F.replace(acc, bare, F.lit(""))).otherwise(acc)

    text = F.concat(col(setup), F.lit("\n"))
    return F.aggregate(lines(text), text, without)


def go_packages_used(program: Column | str) -> Column:
    """Known packages that code lines use and the program does not declare, by last path part."""
    code_lines = F.filter(lines(program), lambda x: ~F.startswith(lstrip(x), F.lit("//")))

    def wanted_name(package: str) -> Column:
        name = package.rsplit("/", 1)[-1]
        used = F.exists(code_lines, lambda x: F.contains(x, F.lit(name + ".")))
        declared = F.contains(col(program), F.lit(f'"{package}"'))
        return F.when(used & ~declared, F.lit(name))

    wanted = [wanted_name(p) for p in GO_PACKAGES]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*wanted))))


def runnable_go(code: Column | str, setup: Column | str, test: Column | str) -> Column:
    """Setup, missing imports in name order, then the code."""
    start = unused_setup(setup, code)
    whole = F.concat(start, col(code), F.lit("\n"), col(test))
    used = let(whole, go_packages_used)
    quoted = F.array_join(F.transform(used, lambda p: F.concat(F.lit('    "'), p, F.lit('"'))), "\n")
    imports = F.when(F.size(used) > 0, F.concat(F.lit("import (\n"), quoted, F.lit("\n)\n"))).otherwise(F.lit(""))
    package = F.lit("package main")
    body = F.when(F.contains(start, package), F.replace(col(code), package, F.lit(""))).otherwise(col(code))
    return F.concat(start, imports, body)


def snake_case(name: Column | str) -> Column:
    """Camel-case name in lower case with underscores."""
    return F.lower(F.regexp_replace(col(name), r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def chat_answer(content: Column | str, entry_point: Column | str) -> Column:
    """Code of a chat answer: inside the first fence, after the entry point and without that line.

    The entry point is looked for as written, in snake case, and with a lower
    first letter; null when none occurs.
    """
    content, entry = col(content), col(entry_point)
    fenced = F.when(F.contains(content, F.lit("```")), F.get(F.split(content, "```", -1), F.lit(1))).otherwise(content)
    spellings = [entry, snake_case(entry), F.concat(F.lower(F.left(entry, F.lit(1))), drop_chars(entry, 1))]
    out = None
    for name in spellings:
        rest = F.call_function("substring_index", fenced, name, F.lit(-1))
        at = F.instr(rest, F.lit("\n"))
        body = F.when(at > 0, drop_chars(rest, at)).otherwise(F.lit(""))
        found = F.contains(fenced, name)
        out = F.when(found, body) if out is None else out.when(found, body)
    return out


def parse_error_rate(df: DataFrame, answer: Column | str) -> DataFrame:
    return df.agg(F.avg(col(answer).isNull().cast("double")).alias("parse_error_rate"))
