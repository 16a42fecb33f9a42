"""Classification and counts of finished program runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col

OK, TIMEOUT, EXCEPTION = "OK", "Timeout", "Exception"
SYNTAX, ASSERTION, REFERENCE = "SyntaxError", "AssertionError", "ReferenceError"
OUTPUT_CHARS = 2048

# Language names and aliases, with the extension of their files.
EXTENSIONS = {
    "rb": ".rb",
    "lua": ".lua",
    "python": ".py",
    "py": ".py",
    "notypes.py": ".py",
    "julia": ".jl",
    "java": ".java",
    "rust": ".rs",
    "rs": ".rs",
    "swift": ".swift",
    "racket": ".rkt",
    "rkt": ".rkt",
    "javascript": ".js",
    "js": ".js",
    "cpp": ".cpp",
    "cs": ".cs",
    "php": ".php",
    "humaneval_to_dlang.py": ".d",
    "d": ".d",
    "r": ".r",
    "humaneval_to_r.py": ".r",
    "jl": ".jl",
    "ts": ".ts",
    "go": ".go",
    "pl": ".pl",
    "sh": ".sh",
    "scala": ".scala",
    "go_test.go": "_test.go",
}
# Seconds per candidate, and parallel workers, by language.
TIMEOUT_SECONDS = {"python": 10, "cpp": 60, "js": 10, "java": 10, "go": 60, "rust": 300}
WORKERS = {"python": 4, "cpp": 4, "js": 4, "java": 1, "go": 4, "rust": 1}


class _Run:
    """Columns of a run row, with the tests the rules are made of."""

    def __init__(self) -> None:
        self.out = F.coalesce(F.col("stdout"), F.lit(""))
        self.err = F.coalesce(F.col("stderr"), F.lit(""))
        self.zero = F.coalesce(F.col("exit_code") == 0, F.lit(False))
        self.timeout = F.coalesce(F.col("timeout"), F.lit(False))
        self.build = F.col("phase") == "build"

    def err_has(self, text: str) -> Column:
        return F.contains(self.err, F.lit(text))

    def out_has(self, text: str) -> Column:
        return F.contains(self.out, F.lit(text))

    def any_has(self, text: str) -> Column:
        return self.out_has(text) | self.err_has(text)


Rule = tuple[Column, str]


def _build_first(r: _Run) -> list[Rule]:
    return [(r.build & ~r.zero, SYNTAX)]


def _script_errors(has: Callable[[str], Column]) -> list[Rule]:
    return [(has("ERR_ASSERTION"), ASSERTION), (has(SYNTAX), SYNTAX), (has(REFERENCE), REFERENCE)]


def _rules(r: _Run) -> dict[str, list[Rule]]:
    """Per file extension the rules in order; a row that meets none is an Exception."""
    go = [
        (r.timeout, TIMEOUT),
        (r.out_has("[setup failed]") | r.out_has("[build failed]"), SYNTAX),
        (~r.out_has("FAIL"), OK),
    ]
    late, ok = (r.timeout, TIMEOUT), (r.zero, OK)
    silent = F.length(r.err) == 0
    compiled = [*_build_first(r), late, ok]
    timed_build = [(r.build & r.timeout, TIMEOUT), *compiled]
    failed = r.err_has("System.Diagnostics.DefaultTraceListener.Fail") | r.err_has("Unhandled Exception")
    return {
        ".cpp": compiled,
        ".java": compiled,
        ".rs": timed_build,
        ".swift": timed_build,
        ".cs": [*_build_first(r), late, (~failed, OK)],
        ".scala": [*_build_first(r), late, (r.zero & silent, OK)],
        ".ts": [*compiled, *_script_errors(r.err_has)],
        ".js": [late, ok, *_script_errors(r.any_has)],
        ".d": [late, ok, (r.err_has("Error:"), SYNTAX)],
        ".go": go,
        "_test.go": go,
        ".jl": [late, ok, (~silent, SYNTAX)],
        ".rb": [late, ok, (~silent, SYNTAX)],
        ".lua": [late, ok],
        ".php": [(r.out_has("PHP Parse error"), SYNTAX), ok],
        ".pl": [late, (r.zero & ~r.any_has("ERROR"), OK)],
        ".py": [late, ok, (r.err_has(SYNTAX), SYNTAX)],
        ".r": [late, ok, (r.any_has("unexpected"), SYNTAX), (silent, ASSERTION)],
        ".rkt": [(r.zero & silent, OK), (r.err_has("read-syntax"), SYNTAX)],
        ".sh": [late, ok, (r.err_has("syntax error"), SYNTAX)],
    }


def extension_of(language: Column | str) -> Column:
    """File extension of a language name or alias; an unknown one is its own extension."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(table[col(language)], F.concat(F.lit("."), col(language)))


def run_status(language: Column | str = "language") -> Column:
    """Status of each run from its phase, exit code, timeout flag and output.

    One nested conditional over the results table: by language first, then
    that language's rules in order.  Unknown languages go by exit code alone.
    """
    r = _Run()
    ext = extension_of(language)

    def chain(rules: list[Rule]) -> Column:
        out = F.lit(EXCEPTION)
        for test, status in reversed(rules):
            out = F.when(test, F.lit(status)).otherwise(out)
        return out

    picked = None
    for name, rules in _rules(r).items():
        picked = F.when(ext == name, chain(rules)) if picked is None else picked.when(ext == name, chain(rules))
    return picked.otherwise(chain([(r.timeout, TIMEOUT), (r.zero, OK)]))


def clean_output(stdout: Column | str) -> Column:
    """Captured output for keeping: never null, without type tags, at most 2048 characters."""
    text = F.replace(F.coalesce(col(stdout), F.lit("")), F.lit("!!int"), F.lit(""))
    return F.substring(text, 1, OUTPUT_CHARS)


def clean_errors(stderr: Column | str) -> Column:
    return F.substring(F.coalesce(col(stderr), F.lit("")), 1, OUTPUT_CHARS)


def status_counts(runs: DataFrame, language: str = "language", status: str = "status") -> DataFrame:
    """Per language: runs in all, syntax errors, passed, and whether everything passed."""
    return runs.groupBy(language).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(status) == SYNTAX).alias("syntax_errors"),
        F.count_if(F.col(status) == OK).alias("passed"),
        F.bool_and(F.col(status) == OK).alias("all_passed"),
    )


def status_table(runs: DataFrame, language: str = "language", status: str = "status") -> DataFrame:
    """Per language one column with the count of each status."""
    known = [OK, TIMEOUT, EXCEPTION, SYNTAX, ASSERTION, REFERENCE]
    return runs.groupBy(language).pivot(status, known).agg(F.count(F.lit(1))).fillna(0, known)


def require_all_passed(counts: DataFrame) -> DataFrame:
    """Raise when a language has runs that did not pass."""
    if not counts.filter(F.col("total") != F.col("passed")).isEmpty():
        raise ValueError("not every run passed")
    return counts


def run_limits(language: Column | str) -> tuple[Column, Column]:
    """Timeout in seconds and number of workers by language; null where not defined."""

    def look(table: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(language)]

    return look(TIMEOUT_SECONDS), look(WORKERS)


def with_number_gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """Every number from 0 to the highest of each group; missing ones have null columns."""
    top = df.groupBy(group).agg(F.max(number).alias("_top"))
    # Ranges of 10,000 numbers are spread before they are written out.
    chunk = 10_000
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_top") / chunk))
    spread = top.withColumn("_c", F.explode(starts)).repartition(group, "_c")
    inside = F.sequence(F.col("_c") * chunk, F.least(F.col("_top"), F.col("_c") * chunk + chunk - 1))
    every = spread.select(group, F.explode(inside).alias(number))
    return every.join(df.withColumn(number, F.col(number).cast("bigint")), [group, number], "left")
