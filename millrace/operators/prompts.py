"""Prompts and references for scoring runs, as columns over problem tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col, drop_chars, has_text, strip
from millrace.operators.prefix import ROWS_PER_BUCKET, range_bounds, range_bucket, with_running_totals

# Language names and file extensions.
LANGUAGE_NAMES = {"python": "Python", "cpp": "C++", "js": "JavaScript", "java": "Java", "go": "Go", "rust": "Rust"}
FILE_EXTENSIONS = {"python": "py", "cpp": "cpp", "js": "js", "java": "java", "go": "go", "rust": "rs"}
RUST_MAIN = "fn main(){}\n"

# Prompt layouts by style.  {input} is instruction and context, {base} the code to continue.
TASK_INTRO = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
STYLE_LAYOUTS = {
    "continue": "{base}",
    "instruct": "{input}\n\n{base}",
    "octocoder": "Question: {input}\n\nAnswer:\n{base}",
    "octogeex": "Question: {stripped}\n\nAnswer:\n{base}",
    "starchat": "<|system|>\n<|end|>\n<|user|>\n{input}<|end|>\n<|assistant|>\n{base}",
    "starcodercommit": "<commit_before><commit_msg>{input}<commit_after>{base}",
    "instructcodet5p": TASK_INTRO + "### Instruction:\n{input}\n\n### Response:{base}",
    "wizardcoder": TASK_INTRO + "### Instruction:\n{input}\n\n### Response:\n{base}",
    "codellama": "[INST] {stripped} [/INST] {base}",
    "sections": "### Instruction:\n{input}\n\n### Response:\n{base}",
}
CONTEXT_FIRST = ("continue", "instruct")
# Layouts of the bug-fix styles that show the file before and after.
FIX_LAYOUTS = {
    "file": "<file_name>\n{file}\n<commit_before>\n{context}\n<commit_msg>\n{instruction}<commit_after>\n{base}",
    "starcodercommit": "<commit_before>{context}<commit_msg>{instruction}<commit_after>{base}",
    "diff": "<commit_before>{context}<commit_msg>{instruction}<commit_after>",
    "diff-carper": "<NME> {file}\n<BEF> {context}\n<MSG> {instruction}\n<DFF>",
}
# Text that asks for a description, by language.
DESCRIBE_SUFFIX = {
    "python": '\n""" The goal of this function is to:\n',
    "ruby": "\n=begin The goal of this function is to:\n",
}
DESCRIBE_SUFFIX_OTHER = "\n/* The goal of this function is to:\n"
# Infilling marks (prefix, suffix, middle) by model.
INFILL_MARKS = {
    "facebook/incoder-1B": ("", "<|mask:0|>", "<|mask:0|>"),
    "facebook/incoder-6B": ("", "<|mask:0|>", "<|mask:0|>"),
    "bigcode/santacoder": ("<fim-prefix>", "<fim-suffix>", "<fim-middle>"),
    "bigcode/starcoder": ("<fim_prefix>", "<fim_suffix>", "<fim_middle>"),
    "bigcode/starcoderbase": ("<fim_prefix>", "<fim_suffix>", "<fim_middle>"),
}
QUOTES = ('"""', "'''")


def fill(layout: str, **parts: Column | str) -> Column:
    """A layout string with its {names} replaced by columns."""
    pieces: list[Column] = []
    for chunk in layout.replace("}", "{").split("{"):
        if len(pieces) % 2:
            pieces.append(col(parts[chunk]))
        else:
            pieces.append(F.lit(chunk))
    return F.concat(*pieces)


def test_reference(test: Column | str, entry_point: Column | str) -> Column:
    """Test program that ends in a call of the checker."""
    return fill("\n{test}\ncheck({entry})", test=test, entry=entry_point)


def problem_prompt(prompt: Column | str, stripped: bool = True) -> Column:
    return strip(prompt) if stripped else col(prompt)


def prompt_base(language: Column | str, prompt: Column | str, declaration: Column | str, with_docs: bool) -> Column:
    """Code to continue: with its documentation, or the bare declaration (Rust gets an empty main)."""
    if with_docs:
        return col(prompt)
    return F.when(col(language) == "rust", F.concat(F.lit(RUST_MAIN), col(declaration))).otherwise(col(declaration))


def styled_prompt(style: str, base: Column | str, instruction: Column | str, context: Column | str | None = None) -> Column:
    """Prompt in one of the styles; context precedes the instruction in the plain ones only."""
    if style not in STYLE_LAYOUTS:
        raise ValueError(f"unknown prompt style {style!r}")
    if context is None:
        shown = col(instruction)
    elif style == "continue":
        raise ValueError("the continue style takes no context")
    elif style in CONTEXT_FIRST:
        shown = fill("{context}\n{instruction}", context=context, instruction=instruction)
    else:
        shown = fill("{instruction}\n{context}", context=context, instruction=instruction)
    return strip(fill(STYLE_LAYOUTS[style], input=shown, stripped=strip(shown), base=base))


def prompt_by_style(style: Column | str, base: Column | str, instruction: Column | str, context: Column | str) -> Column:
    """As :func:`styled_prompt` with the style in a column; null for an unknown style."""
    out = None
    for name in STYLE_LAYOUTS:
        if name == "continue":
            made = strip(base)
        else:
            made = styled_prompt(name, base, instruction, context)
        out = F.when(col(style) == name, made) if out is None else out.when(col(style) == name, made)
    return out


def file_name(entry_point: Column | str, language: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FILE_EXTENSIONS.items() for x in kv])
    return F.concat(F.coalesce(col(entry_point), F.lit("solution")), F.lit("."), table[col(language)])


def fix_instruction(entry_point: Column | str) -> Column:
    return fill("Fix bugs in {entry}.", entry=entry_point)


def fix_prompt(
    style: str,
    language: Column | str,
    base: Column,
    buggy: Column | str,
    entry_point: Column | str,
    test: Column | str | None = None,
) -> Column:
    """Bug-fix prompt; ``test`` is shown where the code carries no documentation."""
    context = F.concat(base, col(buggy))
    if test is not None:
        context = F.concat(context, F.lit("\n"), col(test))
    ask = fix_instruction(entry_point)
    if style in FIX_LAYOUTS:
        made = fill(
            FIX_LAYOUTS[style], file=file_name(entry_point, language), context=context, instruction=ask, base=base
        )
        return strip(made)
    return styled_prompt(style, base, ask, context)


def describe_instruction(docstring: Column | str) -> Column:
    return fill(
        "Provide a concise natural language description of the code using at most {n} characters.",
        n=F.length(col(docstring)).cast("string"),
    )


def describe_prompt(style: str, base: Column, solution: Column | str, docstring: Column | str) -> Column:
    return styled_prompt(style, F.lit(""), describe_instruction(docstring), F.concat(base, col(solution)))


def synthesize_instruction(language: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return fill("Write functional code in {name} according to the description.", name=table[col(language)])


def synthesize_from_description(style: str, language: Column | str, base: Column, description: Column | str) -> Column:
    return styled_prompt(style, base, synthesize_instruction(language), description)


def synthesize_prompt(style: str, base: Column, instruction: Column | str) -> Column:
    return styled_prompt(style, base, strip(instruction))


def chat_fix_prompt(base: Column, buggy: Column | str, entry_point: Column | str) -> Column:
    return fill("{base}{buggy}\n{ask}", base=base, buggy=buggy, ask=fix_instruction(entry_point))


def chat_describe_prompt(base: Column, solution: Column | str, docstring: Column | str) -> Column:
    return fill("{ask}\n{base}{solution}", ask=describe_instruction(docstring), base=base, solution=solution)


def chat_synthesize_prompt(language: Column | str, base: Column, description: Column | str) -> Column:
    return fill(
        "{description}\n{ask}\nStart your code with:\n{base}",
        description=description,
        ask=synthesize_instruction(language),
        base=base,
    )


def _before_quotes(text: Column) -> Column:
    """Cut at an opening delimiter: triple double quotes, else triple single ones."""
    double, single = QUOTES
    return F.when(F.contains(text, F.lit(double)), F.substring_index(text, double, 1)).otherwise(
        F.substring_index(text, single, 1)
    )


def docstring_prefix(code: Column | str, docstring: Column | str) -> Column:
    """Code before its docstring, with our delimiter in place of whatever stood there.

    A row whose code lacks the docstring is an error.
    """
    at = F.instr(col(code), col(docstring))
    checked = F.when(at > 0, F.substring(col(code), F.lit(1), at - 1)).otherwise(
        F.raise_error(F.lit("docstring not found in its code"))
    )
    out = _before_quotes(checked)
    for mark in ("'", '"'):
        out = F.regexp_replace(out, f"(?U)(?s)[^'\"]{mark}\\s*$", "")
    return F.concat(out, F.lit(QUOTES[0]))


def _drop_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), F.left(text, F.length(text) - len(suffix))).otherwise(text)


def code_to_text_prompt(language: str, code: Column | str, docstring: Column | str | None = None) -> Column:
    """Function body without its docstring, followed by the request for a description."""
    ending = F.lit(DESCRIBE_SUFFIX.get(language, DESCRIBE_SUFFIX_OTHER))
    if language != "python":
        return F.concat(col(code), ending)
    prefix = docstring_prefix(code, docstring)
    after = drop_chars(code, F.instr(col(code), col(docstring)) - 1 + F.length(col(docstring)))
    for quote in QUOTES:
        prefix = _drop_suffix(strip(prefix), quote)
        after = F.replace(after, F.lit(quote), F.lit(""))
    return F.concat(prefix, after, ending)


def docstring_reference(tokens: Column | str) -> Column:
    """Reference description from its tokens, without newlines and a raw-string mark."""
    joined = F.replace(F.array_join(col(tokens), " "), F.lit("\n"), F.lit(""))
    return F.when(F.startswith(joined, F.lit("r")), drop_chars(joined, 1)).otherwise(joined)


def infill_prompt(model: str, prefix: Column | str, suffix: Column | str, before: str = "") -> Column:
    if model not in INFILL_MARKS:
        raise ValueError(f"infilling is not supported for {model!r}")
    first, second, third = INFILL_MARKS[model]
    return F.concat(F.lit(first + before), col(prefix), F.lit(second), col(suffix), F.lit(third))


def instruction_prompt(
    instruction: Column | str, context: Column | str, marks: tuple[str, str, str] | None = None, before: str = ""
) -> Column:
    """Instruction between its marks, then the context; by default the marks are a line break."""
    user, end, assistant = marks or ("", "", "\n")
    return F.concat(F.lit(before + user), col(instruction), F.lit(end + assistant), col(context))


def require_one_mode(df: DataFrame, mode: Column | str) -> DataFrame:
    """Raise when completion, infilling and instruction prompts are mixed in one run."""
    found = df.select(col(mode).alias("m")).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"mixed prompt modes: {sorted(str(r.m) for r in found)}")
    return df


def numbered_batches(df: DataFrame, order: str, size: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(order, batch): consecutive batches of ``size`` prompts."""
    bucket = range_bucket(order, range_bounds(df, order, rows_per_bucket))
    numbered = with_running_totals(df.select(order), {"_i": F.lit(1)}, [order], bucket)
    return numbered.select(order, F.floor(F.col("_i") / size).cast("bigint").alias("batch"))


def problems_with_descriptions(problems: DataFrame, descriptions: DataFrame, key: str = "task_id", candidates: str = "descriptions") -> DataFrame:
    """One problem row per candidate description, matched by key."""
    listed = descriptions.select(key, F.posexplode(candidates).alias("candidate_id", "description"))
    return problems.join(listed, key)
