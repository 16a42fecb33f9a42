"""Outcome, status, text and token score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.encoders import code_points
from millrace.functions.stem import sql_stems
from millrace.operators import passk, status, textscore, tokenscore
from millrace.plans.mixing import TURN_PAIRS, turn_pairs
from millrace.plans.registry import joined, query, rounded, table
from millrace.session import spread_small


def outcomes(spark, sf_dir):
    """events as attempts: a user is a task, a purchase a pass, the attempt number the candidate."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        "event_id",
        F.col("event_type").alias("perturbation_name"),
        (F.col("event_id") % 2).alias("seed"),
        (F.col("event_type") == "purchase").alias("passed"),
        "value",
    )
    return e


TALLY_SQL = """tally AS (SELECT user_id AS task_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS correct
  FROM events GROUP BY user_id)"""


def pass_sql(k: int) -> str:
    return (
        f"CASE WHEN total - correct < {k} THEN 1.0 WHEN correct = 0 THEN 0.0 ELSE 1.0 - list_product("
        f"list_transform(range(total - correct + 1, total + 1), lambda i: 1.0 - {k}.0 / i)) END"
    )


@query(f"WITH {TALLY_SQL} SELECT * FROM tally")
def task_tallies(spark, sf_dir):
    return passk.task_tallies(outcomes(spark, sf_dir))


@query(f"WITH {TALLY_SQL} SELECT task_id, round({pass_sql(1)}, 6) AS pass_at_1, round({pass_sql(10)}, 6) AS pass_at_10 FROM tally")
def pass_at_k_by_task(spark, sf_dir):
    t = passk.task_tallies(outcomes(spark, sf_dir))
    return rounded(
        t.select("task_id", *[passk.pass_at_k("total", "correct", k).alias(f"pass_at_{k}") for k in (1, 10)]),
        "pass_at_1",
        "pass_at_10",
    )


@query(f"""
WITH {TALLY_SQL} SELECT {', '.join(f"CASE WHEN min(total) >= {k} THEN round(avg({pass_sql(k)}), 6) END AS pass_at_{k}" for k in (1, 10, 25))} FROM tally""")
def pass_at_k(spark, sf_dir):
    t = passk.task_tallies(outcomes(spark, sf_dir))
    return rounded(passk.mean_pass_at_k(t), "pass_at_1", "pass_at_10", "pass_at_25")


LANGS = ("cpp", "cs", "d", "go", "java", "js", "jl", "lua", "php", "pl", "py", "r", "rb", "rkt", "rs", "scala", "sh", "swift", "ts", "zig")
STDOUTS = ("", "[build failed]", "FAIL", "PHP Parse error", "ERROR")
STDERRS = (
    "",
    "SyntaxError",
    "Unhandled Exception",
    "Error: x",
    "ERR_ASSERTION",
    "ReferenceError",
    "unexpected",
    "read-syntax",
    "syntax error",
    "ERROR",
)


def runs(spark, sf_dir):
    """events as finished program runs of every language, phase and kind of output."""
    e = table(spark, sf_dir, "events")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    n = F.col("event_id")
    return e.select(
        "event_id",
        F.col("user_id").alias("task_id"),
        pick(LANGS, n).alias("language"),
        F.when(F.floor(n / 20) % 4 == 0, "build").otherwise("run").alias("phase"),
        pick(STDOUTS, F.floor(n / 80)).alias("stdout"),
        F.when(F.floor(n / 400) % 7 == 6, F.lit(None)).otherwise(pick(STDERRS, F.floor(n / 60))).alias("stderr"),
        (F.col("event_type") == "error").alias("timeout"),
        F.when(F.col("event_type") == "error", -1).when(F.col("value") > 20, 1).otherwise(0).alias("exit_code"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RUNS_SQL = f"""runs AS (SELECT event_id, user_id AS task_id, {_sql_list(LANGS)}[event_id % {len(LANGS)} + 1] AS language,
  CASE WHEN (event_id // 20) % 4 = 0 THEN 'build' ELSE 'run' END AS phase,
  {_sql_list(STDOUTS)}[(event_id // 80) % {len(STDOUTS)} + 1] AS o,
  CASE WHEN (event_id // 400) % 7 = 6 THEN '' ELSE {_sql_list(STDERRS)}[(event_id // 60) % {len(STDERRS)} + 1] END AS e,
  event_type = 'error' AS late, CASE WHEN event_type = 'error' THEN -1 WHEN value > 20 THEN 1 ELSE 0 END AS code FROM events),
classified AS (SELECT *, CASE
  WHEN language IN ('rs', 'swift') AND phase = 'build' AND late THEN 'Timeout'
  WHEN language IN ('cpp', 'java', 'rs', 'swift', 'cs', 'scala', 'ts') AND phase = 'build' AND code <> 0 THEN 'SyntaxError'
  WHEN language = 'php' THEN CASE WHEN contains(o, 'PHP Parse error') THEN 'SyntaxError' WHEN code <> 0 THEN 'Exception' ELSE 'OK' END
  WHEN language = 'rkt' THEN CASE WHEN e = '' AND code = 0 THEN 'OK' WHEN contains(e, 'read-syntax') THEN 'SyntaxError' ELSE 'Exception' END
  WHEN late THEN 'Timeout'
  WHEN language = 'cs' THEN CASE WHEN contains(e, 'Unhandled Exception') THEN 'Exception' ELSE 'OK' END
  WHEN language = 'go' THEN CASE WHEN contains(o, '[build failed]') THEN 'SyntaxError' WHEN contains(o, 'FAIL') THEN 'Exception' ELSE 'OK' END
  WHEN language = 'scala' THEN CASE WHEN code = 0 AND e = '' THEN 'OK' ELSE 'Exception' END
  WHEN language = 'pl' THEN CASE WHEN code <> 0 OR contains(o, 'ERROR') OR contains(e, 'ERROR') THEN 'Exception' ELSE 'OK' END
  WHEN code = 0 THEN 'OK'
  WHEN language = 'd' AND contains(e, 'Error:') THEN 'SyntaxError'
  WHEN language IN ('jl', 'rb') AND e <> '' THEN 'SyntaxError'
  WHEN language IN ('js', 'ts') AND contains(e, 'ERR_ASSERTION') THEN 'AssertionError'
  WHEN language IN ('js', 'ts', 'py') AND contains(e, 'SyntaxError') THEN 'SyntaxError'
  WHEN language IN ('js', 'ts') AND contains(e, 'ReferenceError') THEN 'ReferenceError'
  WHEN language = 'r' AND contains(e, 'unexpected') THEN 'SyntaxError'
  WHEN language = 'r' AND e = '' THEN 'AssertionError'
  WHEN language = 'sh' AND contains(e, 'syntax error') THEN 'SyntaxError'
  ELSE 'Exception' END AS status FROM runs)"""


def classified(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("status", status.run_status())


@query(f"WITH {RUNS_SQL} SELECT event_id, language, status FROM classified")
def run_statuses(spark, sf_dir):
    return classified(spark, sf_dir).select("event_id", "language", "status")


@query(f"""
WITH {RUNS_SQL} SELECT language, count(*) AS total, count(*) FILTER (status = 'SyntaxError') AS syntax_errors,
  count(*) FILTER (status = 'OK') AS passed, bool_and(status = 'OK') AS all_passed FROM classified GROUP BY language""")
def status_counts(spark, sf_dir):
    return status.status_counts(classified(spark, sf_dir))


@query(f"""
WITH {RUNS_SQL} SELECT language, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('OK', 'Timeout', 'Exception', 'SyntaxError', 'AssertionError', 'ReferenceError'))}
FROM classified GROUP BY language""")
def status_table(spark, sf_dir):
    return status.status_table(classified(spark, sf_dir))


# Two results of one language each, a build and a run or two runs, belong to a candidate; 100 tasks.
CANDIDATES_SQL = f"""{RUNS_SQL}, numbered AS (SELECT *, event_id // 40 * 20 + event_id % 20 AS candidate FROM classified),
ranked AS (SELECT candidate % 100 AS task_id, candidate, phase, status, code, event_id, status <> 'OK' OR code <> 0 AS failed,
  bool_or(phase = 'run') OVER (PARTITION BY candidate) AS ran, row_number() OVER (PARTITION BY candidate
    ORDER BY status = 'OK' AND code = 0, phase = 'run', event_id) AS r,
  row_number() OVER (PARTITION BY candidate ORDER BY phase = 'build', event_id) AS first_run FROM numbered),
outcomes AS (SELECT task_id, candidate,
  CASE WHEN bool_or(failed) THEN max(status) FILTER (r = 1) WHEN bool_or(ran) THEN max(status) FILTER (first_run = 1) ELSE 'Exception' END AS status,
  CASE WHEN bool_or(failed) THEN max(code) FILTER (r = 1) WHEN bool_or(ran) THEN max(code) FILTER (first_run = 1) END AS exit_code
  FROM ranked GROUP BY task_id, candidate)"""


def outcomes_of_candidates(spark, sf_dir):
    number = (F.floor(F.col("event_id") / 40) * 20 + F.col("event_id") % 20).cast("bigint")
    numbered = classified(spark, sf_dir).withColumn("candidate", number).withColumn("task_id", F.col("candidate") % 100)
    return passk.candidate_outcomes(numbered, order="event_id")


@query(f"WITH {CANDIDATES_SQL} SELECT * FROM outcomes")
def candidate_outcomes(spark, sf_dir):
    return outcomes_of_candidates(spark, sf_dir)


@query(f"""
WITH {CANDIDATES_SQL}, tally AS (SELECT task_id, count(*) AS total, count(*) FILTER (status = 'OK' AND exit_code = 0) AS correct FROM outcomes GROUP BY task_id),
f AS (SELECT max(total) FILTER (task_id = 1) AS n FROM tally)
SELECT {', '.join(f"CASE WHEN (SELECT n FROM f) >= {k} THEN round(avg({pass_sql(k)}), 6) END AS pass_at_{k}" for k in (1, 10, 25))} FROM tally""")
def pass_at_k_of_runs(spark, sf_dir):
    scores = passk.pass_at_k_of_runs(outcomes_of_candidates(spark, sf_dir), "task_id", 1)
    return rounded(scores, "pass_at_1", "pass_at_10", "pass_at_25")


@query(f"""
WITH {RUNS_SQL} SELECT event_id, substr(replace(o || '!!int' || e, '!!int', ''), 1, 2048) AS stdout, e AS stderr,
  CASE language WHEN 'py' THEN '.py' ELSE '.' || language END AS extension FROM runs""")
def clean_output(spark, sf_dir):
    r = runs(spark, sf_dir)
    raw = F.concat("stdout", F.lit("!!int"), F.coalesce("stderr", F.lit("")))
    return r.select(
        "event_id",
        status.clean_output(raw).alias("stdout"),
        status.clean_errors("stderr").alias("stderr"),
        status.extension_of("language").alias("extension"),
    )


@query(f"""
WITH {RUNS_SQL} SELECT language, count(*) AS runs, max(CASE language WHEN 'cpp' THEN 60 WHEN 'js' THEN 10 WHEN 'java' THEN 10 WHEN 'go' THEN 60 END) AS timeout_seconds,
  max(CASE language WHEN 'cpp' THEN 4 WHEN 'js' THEN 4 WHEN 'java' THEN 1 WHEN 'go' THEN 4 END) AS workers FROM runs GROUP BY language""")
def run_limits(spark, sf_dir):
    seconds, workers = status.run_limits("language")
    return runs(spark, sf_dir).groupBy("language").agg(
        F.count("*").alias("runs"), F.max(seconds).alias("timeout_seconds"), F.max(workers).alias("workers")
    )


@query("""
WITH d AS (SELECT lang, doc_id // 2 AS number, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
every AS (SELECT lang, unnest(range(max(number) + 1)) AS number FROM d GROUP BY lang)
SELECT e.lang, e.number, d.doc_id FROM every e LEFT JOIN d ON d.lang = e.lang AND d.number = e.number""")
def number_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.floor(F.col("doc_id") / 2).alias("number"))
    return status.with_number_gaps(d.groupBy("lang", "number").agg(F.min("doc_id").alias("doc_id")), "lang", "number")


# Attempts of a task under one perturbation and seed are numbered by event id.
ROBUST_SQL = """o AS (SELECT event_type AS pert, user_id AS task, event_id % 2 AS seed, value < 30 AS passed, event_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY pert, task, seed ORDER BY event_id) - 1 AS idx FROM o),
seeds AS (SELECT pert, task, seed, count(*) AS n, avg(CAST(passed AS INT)) AS rate FROM n GROUP BY ALL),
tasks AS (SELECT pert, task, count(*) AS seeds, arg_min(n, seed) AS first_n, product(rate) AS alt FROM seeds GROUP BY ALL),
idx AS (SELECT pert, task, idx, count(DISTINCT seed) AS seen, bool_and(passed) AS ok FROM n GROUP BY ALL),
solved AS (SELECT i.pert, i.task, count(*) AS solved FROM idx i JOIN tasks t ON i.pert = t.pert AND i.task = t.task
  WHERE ok AND seen = seeds GROUP BY ALL)"""


@query(f"""
WITH {ROBUST_SQL} SELECT t.pert AS perturbation_name, round(avg(coalesce(solved, 0) / first_n), 6) AS robust_pass_at_1,
  round(avg(alt), 6) AS alt_robust_pass_at_1 FROM tasks t LEFT JOIN solved s ON s.pert = t.pert AND s.task = t.task GROUP BY t.pert""")
def robust_pass(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("passed", F.col("value") < 30)
    numbered = passk.number_samples(o, ["perturbation_name", "task_id", "seed"], "event_id")
    return rounded(passk.robust_pass(numbered), "robust_pass_at_1", "alt_robust_pass_at_1")


@query("""
SELECT c.conv_id, c.turn, c.text || chr(10) || s.text AS program FROM conversations c
JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = 0 WHERE c.role = 'assistant'""")
def candidate_programs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.filter("role = 'assistant'").select(F.col("conv_id").alias("task_id"), "turn", F.col("text").alias("completion"))
    tests = c.filter("turn = 0").select(F.col("conv_id").alias("task_id"), F.col("text").alias("test"))
    p = passk.candidate_programs(answers, tests)
    return p.select(F.col("task_id").alias("conv_id"), "turn", "program")


def scored_pairs(spark, sf_dir):
    p = turn_pairs(spark, sf_dir).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    return p.select("pair_id", "asked", "answered")


def _norm_sql(text: str) -> str:
    out = f"array_to_string(regexp_extract_all(lower(trim(split_part(trim({text}, chr(10) || ' '), chr(9), 1), chr(10) || ' ')), '([\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_])'), ' ')"
    for a, b in (("<skipped>", ""), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"lower(' ' || {out} || ' ')"
    for pattern, repl in textscore.PUNCTUATION_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{repl.replace('$', chr(92))}', 'g')"
    return rf"regexp_extract_all({out}, '\S+')"


BLEU_SQL = f"""{TURN_PAIRS}, norm AS (SELECT conv_id * 1000 + turn AS pair_id, {_norm_sql('answered')} AS h, {_norm_sql('asked')} AS r FROM pairs),
grams AS (SELECT pair_id, side, n, g, count(*) AS c FROM (
  SELECT pair_id, side, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM (SELECT pair_id, 'h' AS side, h AS w FROM norm UNION ALL SELECT pair_id, 'r', r FROM norm), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
hit AS (SELECT a.pair_id, a.n, sum(least(a.c, coalesce(b.c, 0))) AS m FROM grams a LEFT JOIN grams b
  ON b.pair_id = a.pair_id AND b.n = a.n AND b.g = a.g AND b.side = 'r' WHERE a.side = 'h' GROUP BY ALL),
terms AS (SELECT p.pair_id, sum(ln(coalesce(m, 0) + CASE WHEN p.n > 1 THEN 1.0::DOUBLE ELSE 0 END + 2.2250738585072014e-308)
   - ln(greatest(len(h) - p.n + 1, 0) + CASE WHEN p.n > 1 THEN 1.0::DOUBLE ELSE 0 END + 2.2250738585072014e-308)) / 4 AS logs
  FROM (SELECT * FROM norm, (SELECT unnest([1, 2, 3, 4]) AS n)) p LEFT JOIN hit ON hit.pair_id = p.pair_id AND hit.n = p.n GROUP BY p.pair_id),
bleu AS (SELECT t.pair_id, exp(logs + least(0, 1 - (len(r) + 1.0) / (len(h) + 1.0))) AS bleu FROM terms t JOIN norm n ON n.pair_id = t.pair_id)"""


def pair_bleu(spark, sf_dir):
    p = scored_pairs(spark, sf_dir)
    return textscore.pair_bleu(p, "pair_id", "answered", "asked")


@query(f"WITH {BLEU_SQL} SELECT pair_id, round(bleu, 6) AS bleu FROM bleu")
def bleu_pairs(spark, sf_dir):
    return rounded(pair_bleu(spark, sf_dir), "bleu")


@query(f"WITH {BLEU_SQL} SELECT round(avg(bleu) * 100, 6) AS bleu, count(*) AS sentences FROM bleu")
def bleu_corpus(spark, sf_dir):
    return rounded(textscore.corpus_bleu(pair_bleu(spark, sf_dir)), "bleu")


@query(f"WITH {BLEU_SQL} SELECT pair_id, array_to_string(h, ' ') AS predicted, array_to_string(r, ' ') AS expected FROM norm")
def bleu_words(spark, sf_dir):
    p = scored_pairs(spark, sf_dir)

    def shown(c):
        return F.array_join(textscore.normalized_words(textscore.scored_text(c)), " ")

    return p.select("pair_id", shown("answered").alias("predicted"), shown("asked").alias("expected"))


def rouge_sql(n: int) -> str:
    gram = f"list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
    return f"""WITH {TURN_PAIRS}, t AS (SELECT conv_id * 1000 + turn AS pair_id, regexp_extract_all(lower(answered), '[a-z0-9]+') AS p,
  regexp_extract_all(lower(asked), '[a-z0-9]+') AS e FROM pairs),
g AS (SELECT pair_id, side, g, count(*) AS c FROM (SELECT pair_id, side, unnest({gram}) AS g FROM (
  SELECT pair_id, 'p' AS side, p AS w FROM t UNION ALL SELECT pair_id, 'e', e FROM t)) GROUP BY ALL),
h AS (SELECT a.pair_id, sum(least(a.c, b.c)) AS hits FROM g a JOIN g b ON a.pair_id = b.pair_id AND a.g = b.g AND a.side = 'p' AND b.side = 'e' GROUP BY ALL)
SELECT t.pair_id, round(coalesce(hits * 2.0 / (greatest(len(p) - {n} + 1, 0) + greatest(len(e) - {n} + 1, 0)), 0), 6) AS rouge{n} FROM t LEFT JOIN h ON h.pair_id = t.pair_id"""


@query(rouge_sql(1))
def rouge_unigrams(spark, sf_dir):
    return rounded(textscore.rouge_n(scored_pairs(spark, sf_dir), "pair_id", "answered", "asked", 1), "rouge1")


@query(rouge_sql(2))
def rouge_bigrams(spark, sf_dir):
    return rounded(textscore.rouge_n(scored_pairs(spark, sf_dir), "pair_id", "answered", "asked", 2), "rouge2")


STEMMED_SQL = f"""{TURN_PAIRS}, given AS (SELECT conv_id * 1000 + turn AS pair_id, 'p' AS side, answered AS text FROM pairs UNION ALL SELECT conv_id * 1000 + turn, 'e', asked FROM pairs),
lines AS (SELECT pair_id, side, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS s FROM given),
line_words AS (SELECT pair_id, side, s, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM lines),
rouge_words AS (SELECT pair_id, side, s, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM line_words),
long_words AS (SELECT DISTINCT word FROM rouge_words WHERE length(word) > 3), {sql_stems('long_words')},
toks AS MATERIALIZED (SELECT pair_id, side, s, k, coalesce(stem, w.word) AS t FROM rouge_words w LEFT JOIN stemmed USING (word)),
whole AS MATERIALIZED (SELECT pair_id, side, list(t ORDER BY s, k) AS w FROM toks GROUP BY ALL),
both_sides AS MATERIALIZED (SELECT p.pair_id, coalesce(a.w, []) AS p, coalesce(b.w, []) AS e FROM (SELECT DISTINCT pair_id FROM given) p
  LEFT JOIN whole a ON a.pair_id = p.pair_id AND a.side = 'p' LEFT JOIN whole b ON b.pair_id = p.pair_id AND b.side = 'e')"""


def _overlap_sql(n: int) -> str:
    gram = f"list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
    return f"""grams{n} AS (SELECT pair_id, side, g, count(*) AS c FROM (SELECT pair_id, side, unnest({gram}) AS g FROM whole) GROUP BY ALL),
hits{n} AS (SELECT a.pair_id, sum(least(a.c, b.c)) AS hits FROM grams{n} a JOIN grams{n} b ON a.pair_id = b.pair_id AND a.g = b.g AND a.side = 'p' AND b.side = 'e' GROUP BY ALL),
rouge{n} AS (SELECT t.pair_id, coalesce(hits * 2.0 / (greatest(len(p) - {n} + 1, 0) + greatest(len(e) - {n} + 1, 0)), 0)::DOUBLE AS rouge{n}
  FROM both_sides t LEFT JOIN hits{n} h ON h.pair_id = t.pair_id)"""


# Rows of the table of common subsequences by recursion over predicted words, and the way back by recursion over its cells.
SUBSEQUENCE_SQL = """sentences AS (SELECT pair_id, side, s, list(t ORDER BY k) AS w FROM toks GROUP BY ALL),
jobs AS MATERIALIZED (SELECT pair_id, 0 AS es, 0 AS ps, e, p FROM both_sides WHERE len(e) > 0 AND len(p) > 0
  UNION ALL SELECT a.pair_id, a.s, b.s, a.w, b.w FROM sentences a JOIN sentences b ON a.pair_id = b.pair_id AND a.side = 'e' AND b.side = 'p'),
cells AS (SELECT pair_id, es, ps, e, p, 0 AS j, list_transform(range(0, len(e) + 1), lambda i: CAST(0 AS BIGINT)) AS r FROM jobs
  UNION ALL SELECT pair_id, es, ps, e, p, j + 1, list_concat([CAST(0 AS BIGINT)], list_transform(range(1, len(e) + 1), lambda i:
    greatest(r[i + 1], coalesce(list_max(list_transform(list_filter(range(1, i + 1), lambda k: e[k] = p[j + 1]), lambda k: r[k] + 1)), 0)))) FROM cells WHERE j < len(p)),
stored AS MATERIALIZED (SELECT * FROM cells),
back AS (SELECT pair_id, es, ps, len(e) AS i, len(p) AS j, CAST(NULL AS BIGINT) AS used FROM jobs WHERE es > 0
  UNION ALL SELECT b.pair_id, b.es, b.ps, CASE WHEN x.e[b.i] <> x.p[b.j] AND y.r[b.i + 1] > x.r[b.i] THEN b.i ELSE b.i - 1 END,
    CASE WHEN x.e[b.i] = x.p[b.j] OR y.r[b.i + 1] > x.r[b.i] THEN b.j - 1 ELSE b.j END, CASE WHEN x.e[b.i] = x.p[b.j] THEN b.i END
  FROM back b JOIN stored x ON x.pair_id = b.pair_id AND x.es = b.es AND x.ps = b.ps AND x.j = b.j
  JOIN stored y ON y.pair_id = b.pair_id AND y.es = b.es AND y.ps = b.ps AND y.j = b.j - 1 WHERE b.i > 0 AND b.j > 0),
covered AS (SELECT pair_id, t, count(*) AS c FROM (SELECT DISTINCT b.pair_id, b.es, b.used, s.w[b.used] AS t FROM back b
  JOIN sentences s ON s.pair_id = b.pair_id AND s.side = 'e' AND s.s = b.es WHERE b.used IS NOT NULL) GROUP BY ALL),
there AS (SELECT pair_id, t, count(*) AS c FROM toks WHERE side = 'p' GROUP BY ALL),
hits_sum AS (SELECT a.pair_id, sum(least(a.c, b.c)) AS hits FROM covered a JOIN there b USING (pair_id, t) GROUP BY ALL),
hits_l AS (SELECT pair_id, r[len(e) + 1] AS hits FROM stored WHERE es = 0 AND j = len(p)),
rouge_l AS (SELECT t.pair_id, CASE WHEN l.hits > 0 THEN l.hits * 2.0 / (len(p) + len(e)) ELSE 0 END::DOUBLE AS rougeL,
  CASE WHEN m.hits > 0 THEN m.hits * 2.0 / (len(p) + len(e)) ELSE 0 END::DOUBLE AS rougeLsum
  FROM both_sides t LEFT JOIN hits_l l ON l.pair_id = t.pair_id LEFT JOIN hits_sum m ON m.pair_id = t.pair_id)"""


@query(f"WITH {STEMMED_SQL}, {_overlap_sql(1)} SELECT pair_id, round(rouge1, 6) AS rouge1 FROM rouge1")
def rouge_stems(spark, sf_dir):
    return rounded(textscore.rouge_n(scored_pairs(spark, sf_dir), "pair_id", "answered", "asked", 1, stemmed=True), "rouge1")


@query(f"WITH RECURSIVE {STEMMED_SQL}, {SUBSEQUENCE_SQL} SELECT pair_id, round(rougeL, 6) AS \"rougeL\", round(rougeLsum, 6) AS \"rougeLsum\" FROM rouge_l")
def rouge_subsequences(spark, sf_dir):
    p = scored_pairs(spark, sf_dir)
    whole = textscore.rouge_l(p, "pair_id", "answered", "asked", stemmed=True)
    return rounded(whole.join(textscore.rouge_lsum(p, "pair_id", "answered", "asked", stemmed=True), "pair_id"), "rougeL", "rougeLsum")


@query(f"""
WITH RECURSIVE {STEMMED_SQL}, {_overlap_sql(1)}, {_overlap_sql(2)}, {SUBSEQUENCE_SQL}
SELECT round(avg(rouge1) * 100, 6) AS rouge1, round(avg(rouge2) * 100, 6) AS rouge2, round(avg(rougeL) * 100, 6) AS "rougeL", round(avg(rougeLsum) * 100, 6) AS "rougeLsum"
FROM rouge1 JOIN rouge2 USING (pair_id) JOIN rouge_l USING (pair_id)""")
def rouge_pairs(spark, sf_dir):
    return rounded(textscore.rouge(scored_pairs(spark, sf_dir), "pair_id", "answered", "asked"), "rouge1", "rouge2", "rougeL", "rougeLsum")


@query(f"""
WITH {TURN_PAIRS}, last AS (SELECT conv_id, arg_max(answered, turn) AS answered FROM pairs GROUP BY conv_id),
hyp AS (SELECT conv_id, {_norm_sql('answered')} AS h FROM last), refs AS (SELECT conv_id, turn, {_norm_sql('asked')} AS r FROM pairs),
orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT conv_id, n, g, count(*) AS c FROM (SELECT conv_id, n, unnest(list_transform(range(1, greatest(len(h) - n + 2, 1)), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM hyp, orders) GROUP BY ALL),
rg AS (SELECT conv_id, n, g, max(c) AS c FROM (SELECT conv_id, turn, n, g, count(*) AS c FROM (
  SELECT conv_id, turn, n, unnest(list_transform(range(1, greatest(len(r) - n + 2, 1)), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM refs, orders) GROUP BY ALL) GROUP BY ALL),
hit AS (SELECT a.conv_id, a.n, sum(least(a.c, coalesce(b.c, 0))) AS m FROM hg a LEFT JOIN rg b ON b.conv_id = a.conv_id AND b.n = a.n AND b.g = a.g GROUP BY ALL),
terms AS (SELECT p.conv_id, sum(ln(coalesce(m, 0) + CASE WHEN p.n > 1 THEN 1.0::DOUBLE ELSE 0 END + 2.2250738585072014e-308)
   - ln(greatest(len(h) - p.n + 1, 0) + CASE WHEN p.n > 1 THEN 1.0::DOUBLE ELSE 0 END + 2.2250738585072014e-308)) / 4 AS logs
  FROM (SELECT * FROM hyp, orders) p LEFT JOIN hit ON hit.conv_id = p.conv_id AND hit.n = p.n GROUP BY p.conv_id),
lengths AS (SELECT conv_id, min(len(r)) AS r FROM refs GROUP BY conv_id)
SELECT hyp.conv_id, round(exp(logs + least(0.0, 1 - (lengths.r + 1.0::DOUBLE) / (len(h) + 1.0::DOUBLE))), 6) AS bleu
FROM hyp JOIN terms USING (conv_id) JOIN lengths USING (conv_id)""")
def bleu_by_id(spark, sf_dir):
    """Repeated ids: the last answer of a conversation against all its questions."""
    p = scored_pairs(spark, sf_dir).withColumn("conv_id", F.floor(F.col("pair_id") / 1000))
    answers = p.select("conv_id", "pair_id", F.col("answered").alias("text"))
    questions = p.select("conv_id", F.col("asked").alias("text"))
    return rounded(textscore.sentence_bleu(answers, questions, "conv_id", order="pair_id"), "bleu")


def predictions(spark, sf_dir):
    """Code points of documents as labels; every 7th prediction is off and every 11th label ignored."""
    d = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.select("doc_id", code_points()("text").alias("ids"))
    return d.select(
        "doc_id",
        F.transform("ids", lambda x, i: F.when(i % 11 == 0, -100).otherwise(x)).alias("labels"),
        F.concat(
            F.transform(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), lambda x, i: F.when(i % 7 == 0, x + 1).otherwise(x)),
            F.array(F.lit(0)),
        ).alias("preds"),
    )


PREDICTIONS_SQL = """ids AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS ids FROM documents WHERE text <> ''),
pos AS (SELECT doc_id, unnest(ids[2:]) AS label, unnest(range(1, len(ids))) AS i FROM ids),
scored AS (SELECT i % 11 = 0 AS ignored, i % 11 <> 0 AND (i - 1) % 7 <> 0 AS hit FROM pos)"""


@query(f"WITH {PREDICTIONS_SQL} SELECT count(*) FILTER (hit) AS hits, count(*) AS positions, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM scored")
def token_accuracy(spark, sf_dir):
    return rounded(tokenscore.token_accuracy(predictions(spark, sf_dir)), "accuracy")


@query(f"WITH {PREDICTIONS_SQL} SELECT count(*) FILTER (hit) AS hits, count(*) AS positions, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM scored WHERE NOT ignored")
def token_accuracy_unmasked(spark, sf_dir):
    return rounded(tokenscore.token_accuracy(predictions(spark, sf_dir), ignore_masked=True), "accuracy")


@query("SELECT round(avg(value) / 10, 6) AS mean_loss, round(exp(avg(value) / 10), 6) AS perplexity FROM events")
def perplexity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 10).alias("loss"))
    return rounded(tokenscore.perplexity(e), "mean_loss", "perplexity")


@query("""
SELECT doc_id, array_to_string(list_transform(list_transform(string_split(text, ''), lambda c: unicode(c)), lambda x, i: CASE WHEN (i - 1) % 11 = 0 THEN -1 ELSE x END), ',') AS ids
FROM documents WHERE text <> ''""")
def unmasked_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", code_points()("text").alias("ids"))
    labels = F.transform("ids", lambda x, i: F.when(i % 11 == 0, -100).otherwise(x))
    return d.select("doc_id", joined(tokenscore.unmask("ids", labels, -1)).alias("ids"))
