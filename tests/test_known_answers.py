"""Small cases with answers worked out by hand."""

import math

import pytest
from millrace.functions.templates import pair_text, parse_pair
from millrace.functions.text import estimate_tokens, first_present, strip, word_count
from millrace.operators import passk, profile, prompts, status, textscore, tokenscore
from millrace.operators.diffs import apply_diff, apply_diff_by_number, diff_state, line_numbers, parse_bundle
from millrace.operators.extract import unify
from millrace.operators.postprocess import (
    after_assistant,
    before_second_margin,
    close_code,
    drop_last_block,
    go_packages_used,
    packed_completion,
    snake_case,
)
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words_and_estimates(spark):
    assert one(spark, estimate_tokens(F.lit("one two three four five"))) == 7
    assert one(spark, word_count(F.lit(" a b c\x1cd\n"))) == 4
    assert one(spark, word_count(F.lit(""))) == 0
    assert one(spark, strip(F.lit(" \x1f a b \n"))) == "a b"


def test_pair_tags(spark):
    text = pair_text(F.lit("x\ny"), F.lit("ir"))
    code, ir = parse_pair(text)
    assert one(spark, text) == "<source>\nx\ny\n</source>\n<llvm_ir>\nir\n</llvm_ir>"
    assert one(spark, F.array(code, ir)) == ["x\ny", "ir"]
    assert one(spark, pair_text(F.lit(""), F.lit("ir"))) == ""
    assert one(spark, parse_pair(F.lit("nothing"))[0]) == ""


def test_first_present(spark):
    df = spark.createDataFrame([("", None, "c")], "a string, b string, c string")
    assert df.select(first_present(df, ["zz", "a", "b", "c"])).first()[0] == "c"
    assert df.select(first_present(df, ["zz", "a"], "d")).first()[0] == "d"


def test_unify_reads_both_language_keys(spark):
    df = spark.createDataFrame(
        [("<source>\na\n</source>\n<llvm_ir>\nb\n</llvm_ir>", "paired_ir", {"lang": "C"}, None)],
        "text string, source string, meta map<string,string>, est_tokens bigint",
    )
    assert tuple(unify(df).first()) == ("a", "b", "C", None, "paired_ir", 0)


def test_percentiles(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "t bigint")
    assert df.agg(profile.percentiles("t")).first()[0] == pytest.approx([1.75, 3.0, 5.25, 8.85])


def test_pass_at_k(spark):
    o = spark.createDataFrame([("t", False), ("t", True)], "task_id string, passed boolean")
    r = passk.mean_pass_at_k(passk.task_tallies(o), (1, 2, 3)).first()
    assert (r["pass_at_1"], r["pass_at_2"], r["pass_at_3"]) == (0.5, 1.0, None)
    none = spark.createDataFrame([("t", False)] * 5, "task_id string, passed boolean")
    assert passk.mean_pass_at_k(passk.task_tallies(none), (2,)).first()[0] == 0.0


def test_robust_pass_needs_every_seed(spark):
    data = [("p", 1, 0, 0, True), ("p", 1, 1, 0, False), ("p", 1, 0, 1, True), ("p", 1, 1, 1, True), ("p", 1, 0, 2, True)]
    o = spark.createDataFrame(data, "perturbation_name string, task_id int, seed int, sample_id int, passed boolean")
    r = passk.robust_pass(o).first()
    assert r["robust_pass_at_1"] == pytest.approx(1 / 3) and r["alt_robust_pass_at_1"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        passk.require_unique_seeds(o, ["perturbation_name", "task_id", "seed"])


def bleu(spark, gold, pred, **kw):
    p = spark.createDataFrame([(1, pred)], "id int, text string")
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate(gold)], "id int, n int, text string")
    return textscore.sentence_bleu(p, g, "id", ref_no="n", **kw).first()["bleu"]


def test_bleu(spark):
    assert bleu(spark, ["the cat sat on the mat"], "the cat sat on the mat") == pytest.approx(1.0)
    # 3 words, one reference of 4: matches 3, 2, 1, 0 with add-one smoothing above unigrams.
    want = math.exp((0 + 0 + 0 + math.log(1 / 1)) / 4 + 1 - 5 / 4)
    assert bleu(spark, ["a b c d"], "a b c\tignored") == pytest.approx(want)
    # "a" twice counts once per reference that has it once; shortest reference is 1.
    want = math.exp((math.log(1 / 2) + math.log(1 / 2) + 0 + 0) / 4)
    assert bleu(spark, ["a", "b a"], "a a") == pytest.approx(want)


def test_reference_length_rules(spark):
    lens, n = F.array(F.lit(3).cast("bigint"), F.lit(8).cast("bigint")), F.lit(7)
    got = [one(spark, textscore.reference_length(lens, n, r)) for r in ("shortest", "average", "closest")]
    assert got == [3.0, 5.5, 8.0]


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_length():
    import random

    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        assert textscore._lcs_length(a, b) == plain_lcs(a, b)
        assert textscore._union_hits([a], [b]) == plain_lcs(a, b)


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat lay"), (2, "", "x")], "id int, p string, e string")
    r = textscore.rouge(df, "id", "p", "e").first()
    assert r["rouge1"] == pytest.approx(100 / 3) and r["rouge2"] == pytest.approx(25.0)
    assert r["rougeL"] == pytest.approx(100 / 3) and r["rougeLsum"] == pytest.approx(100 / 3)
    # Union over predicted lines: w1 w2 w3 are covered by two different lines.
    s = spark.createDataFrame([(1, "w1 w2\nw1 w3", "w1 w2 w3")], "id int, p string, e string")
    assert textscore.rouge_lsum(s, "id", "p", "e").first()[1] == pytest.approx(2 * 3 / 7)


def test_token_accuracy_and_perplexity(spark):
    df = spark.createDataFrame([([7, 8, 9], [-100, 7, 0]), ([1], [1])], "preds array<int>, labels array<int>")
    assert tuple(tokenscore.token_accuracy(df).first()) == (1, 2, 0.5)
    big = spark.createDataFrame([(1000.0,)], "loss double")
    assert tokenscore.perplexity(big).first()["perplexity"] == math.inf


def test_statuses(spark):
    data = [
        ("rs", "build", 1, True, "", "", "Timeout"),
        ("java", "build", 1, True, "", "", "SyntaxError"),
        ("humaneval_to_r.py", "run", 1, False, "", "", "AssertionError"),
        ("racket", "run", 0, False, "", "FAILURE", "Exception"),
        ("go_test.go", "run", 0, False, "", "", "OK"),
        ("notypes.py", "run", 1, False, "", "SyntaxError: x", "SyntaxError"),
    ]
    df = spark.createDataFrame(data, "language string, phase string, exit_code int, timeout boolean, stdout string, stderr string, want string")
    rows = df.withColumn("status", status.run_status()).collect()
    assert [r["status"] for r in rows] == [r["want"] for r in rows]
    with pytest.raises(ValueError):
        status.require_all_passed(status.status_counts(df.withColumn("status", status.run_status())))


def test_completions(spark):
    assert one(spark, close_code(F.lit("    return 1\n\nx = 2\n"), "python", ())) == "    return 1\n"
    assert one(spark, close_code(F.lit(" if (a) { b } } rest }"), "js")) == " if (a) { b } }"
    assert one(spark, close_code(F.lit(" a; } public static void main() { }"), "java")) == " a; } }"
    assert one(spark, close_code(F.lit("{ a; }"), "java")) == "{ a; }"
    assert one(spark, close_code(F.lit("no braces<|endoftext|>x"), "cpp")) == "no braces"
    assert one(spark, before_second_margin(F.lit("def f():\n  a\n\nprint(1)\n"))) == "def f():\n  a\n\n"
    assert one(spark, drop_last_block(F.lit("a\ndef b\nclass c"), ["\ndef", "\nclass"])) == "a\ndef b"
    assert one(spark, drop_last_block(F.lit("abc"), ["\ndef"])) == ""
    made = packed_completion(F.lit("def f():\n    return 1\nprint(f())"), F.lit("def f():"), "python")
    assert one(spark, made) == "def f():\n    return 1"
    assert one(spark, after_assistant(F.lit("x ```python\ncode"), ("", "", "```python"))) == "\ncode"
    assert one(spark, snake_case(F.lit("runCaseTwo"))) == "run_case_two"
    assert one(spark, go_packages_used(F.lit("x := rand.Int()\n// fmt.Print\nstrings.Join"))) == ["rand", "strings"]


def test_prompt_errors(spark):
    with pytest.raises(ValueError):
        prompts.styled_prompt("continue", F.lit("b"), F.lit("i"), F.lit("c"))
    with pytest.raises(ValueError):
        prompts.infill_prompt("unknown", F.lit("a"), F.lit("b"))
    df = spark.createDataFrame([("a",), ("b",)], "mode string")
    with pytest.raises(ValueError):
        prompts.require_one_mode(df, "mode")
    with pytest.raises(Exception, match="docstring not found"):
        one(spark, prompts.code_to_text_prompt("python", F.lit("code"), F.lit("doc")))


FILE = "a\nb\nc\nd"
TWO = "@@ -1,2 +1,2 @@\n a\n-b\n+B\n@@ -4 +4 @@\n-d\n+D\n\\ No newline at end of file"


def test_diffs(spark):
    assert one(spark, apply_diff(F.lit(FILE), F.lit(TWO))) == "a\nB\nc\nD"
    assert one(spark, apply_diff_by_number(F.lit(FILE), F.lit(TWO))) == "a\nB\nc\nD"
    # A second hunk that lies before the first is not found any more.
    back = "@@ -4 +4 @@\n-d\n+D\n@@ -1 +1 @@\n-a\n+A\n"
    assert one(spark, apply_diff(F.lit(FILE), F.lit(back))) == "a\nb\nc\nD"
    assert one(spark, apply_diff(F.lit("ab\nc"), F.lit("@@ -1 +1 @@\n-a\n+z\n"))) == "ab\nc"
    assert one(spark, apply_diff(F.lit("ADDFILE"), F.lit("@@ -0,0 +1,2 @@\n+x\n+y\n"))) == "x\ny"
    assert one(spark, apply_diff(F.lit(FILE), F.lit("@@ -0,0 +1 @@\n+top\n"))) == "top\n" + FILE
    shifted = "@@ -1 +1,2 @@\n-a\n+a1\n+a2\n@@ -3 +4 @@\n-c\n+C\n"
    assert one(spark, apply_diff_by_number(F.lit(FILE), F.lit(shifted))) == "a1\na2\nb\nC\nd"
    assert tuple(one(spark, line_numbers(F.lit("@@ -3 +4,5 @@ def")))) == (3, 1, 4, 5)
    assert one(spark, line_numbers(F.lit("@@ -x +4 @@"))) is None


def test_diff_states(spark):
    def state(file, diff):
        return one(spark, diff_state(F.lit(f"<NME> n\n<BEF> {file}\n<MSG> m\n<DFF> {diff}")))

    assert state(FILE, TWO) == "VALID"
    assert state("ADDFILE", "@@ -0,0 +1,2 @@\n+x\n+y\n") == "VALID"
    assert state("ADDFILE", "@@ -0,0 +1,3 @@\n+x\n+y\n") == "BAD_LINE_NUM_FORMAT"
    assert state("ADDFILE", "@@ -0,0 +1,1 @@\njunk\n") == "BAD_DIFF_HUNK_FORMAT"
    assert state(FILE, "@@ -9,1 +9,1 @@\n-zz\n+y\n") == "INVALID_TEXT"
    assert one(spark, diff_state(F.lit("no bundle"))) == "BAD_FORMAT"
    assert one(spark, parse_bundle(F.lit("<NME> n\n<BEF> f\ng\n<MSG> m\n<DFF> d"))["file"]) == "f\ng"
