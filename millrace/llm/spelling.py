"""Spelling variants: pairs of words one edit apart, by composing finite-state machines.

**Words** are maximal runs of letters, A-Z lowered, some with a planted slip: of
a run whose checksum (with its document's key) is divisible by :data:`SLIPS` one
letter is left out.  Those of :data:`MIN_LENGTH` letters and :data:`MIN_COUNT`
occurrences are the vocabulary, counted with partial aggregation over all texts.

**Partitions.**  One edit leaves the first half of the shorter word alone, or
its second half.  So the vocabulary's acceptor is cut at the states that words
reach after half their letters (for the second half: after those letters, read
from the end), by the shorter length.  Such an initial state has the rests of
the words as its language, and every pair is accepted from exactly one: a pair
with a common second half counts there only if its first halves differ.

**Composition.**  Each partition builds the minimised acceptors of its shorter
and its longer rests over one register of states, and walks through the
composition of acceptor, one-edit transducer and acceptor: before the edit both
sides are in states of one prefix; the edit replaces a letter by a larger one, or
inserts a letter (after all equal ones, so that a pair has one path); behind it
both sides read the same letters, and equal states, which minimisation has made
one, accept all words at once.  States count their words, so a path ends in the
numbers of both words and no string is put together.

**Hot initial states.**  Above :data:`GROUP_WORDS` words an initial state goes
on by one letter: its successors become the initial states, and the edits on
that letter, behind which both rests are equal, are met by the rest as key, at
most an alphabet of words each.  This repeats until every state is small, so no
task sees more, and nothing is left out.

A partition hands on links and the likeliest form per word, not pairs.  A word's
**form** is the near word of largest count (ties: smallest in code-point order)
if that is at least :data:`RATIO` times the word's own; **roots** follow forms by
pointer doubling.

Null texts have no words; a null key counts as empty in the checksum.  Repeated
rows count each.  An empty table, or one without words, gives no rows.  Columns
other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.session import broadcast_if_small, materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIPS = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
GROUP_WORDS = 20_000
COMPOSE, REPLACED, INSERTED = 0, 1, 2


def slipped(run: Column, key: Column) -> Column:
    """The run, without one letter where its checksum says so."""
    mark = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (mark % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(mark % SLIPS == 0, without).otherwise(run)


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = df.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    low = runs.select("key", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    words = low.select(slipped(F.col("run"), F.col("key")).alias("word")).filter(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def initial_states(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(part, kind, rest, long, word, n): up to four rows per word, one for each initial state it is accepted from."""
    size = F.char_length("word")

    def rows(short: Column, long: bool) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        after = short - half
        name = short.cast("string")

        def row(part: Column, rest: Column) -> Column:
            return F.struct(part.alias("part"), rest.alias("rest"), F.lit(long).alias("long"))

        first = row(F.concat(name, F.lit(">"), F.substring("word", F.lit(1), half)), F.substring(F.col("word"), half + 1, size))
        second = row(F.concat(name, F.lit("<"), F.substring(F.col("word"), size - after + 1, after)), F.substring(F.col("word"), F.lit(1), size - after))
        return [first, second]

    as_short, as_long = F.array(*rows(size, False)), F.array(*rows(size - 1, True))
    both = F.when(size > min_length, F.concat(as_short, as_long)).otherwise(as_short)
    return words.select("word", "n", F.explode(both).alias("s")).select("s.part", F.lit(COMPOSE).alias("kind"), "s.rest", "s.long", "word", "n")


def advanced(rows: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Partitions of at most ``group_words`` words; larger initial states go on letter by letter."""
    ready: DataFrame | None = None
    while True:
        rows = materialize(rows)
        hot = materialize(rows.groupBy("part").agg(F.count("*").alias("words")).filter(F.col("words") > group_words).select("part"))
        if hot.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        # at most rows / group_words of them
        hot = broadcast_if_small(hot)
        cold = rows.join(hot, "part", "left_anti")
        large = rows.join(hot, "part", "left_semi")
        tail = F.substring(F.col("rest"), F.lit(2), F.char_length("rest"))
        letter = F.substring("rest", 1, 1)
        step = {"kind": F.lit(REPLACED), "part": F.concat("part", F.lit("="), tail), "rest": letter}
        replaced = large.filter(~F.col("long") & (F.col("rest") != "")).withColumns(step)
        # an insertion at the end of the rest leaves first halves alike, which the other half's partitions have
        at_end = F.col("part").contains("<") & (F.col("rest") == "")
        whole = F.when(F.col("long"), tail).otherwise(F.col("rest"))
        inserted = large.filter(F.col("long") | ~at_end).withColumns({"kind": F.lit(INSERTED), "part": F.concat("part", F.lit("+"), whole), "rest": letter})
        found = materialize(replaced.unionByName(inserted))
        ready = reduce_union(ready, cold, found)
        rows = large.filter(F.col("rest") != "").withColumns({"part": F.concat("part", F.lit("/"), letter), "rest": tail})


def reduce_union(first: DataFrame | None, *others: DataFrame) -> DataFrame:
    for other in others:
        first = other if first is None else first.unionByName(other)
    return first


class Acceptors:
    """Minimised acyclic acceptors over one register; state i has arcs (letter, state, words before it)."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.arcs: list[list[tuple[str, int, int]]] = []
        self.by_letter: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        name = (final, *arcs)
        found = self.register.get(name)
        if found is None:
            found = self.register[name] = len(self.arcs)
            before, placed = int(final), []
            for letter, child in arcs:
                placed.append((letter, child, before))
                before += self.words[child]
            self.arcs.append(placed)
            self.by_letter.append({letter: (child, at) for letter, child, at in placed})
            self.final.append(final)
            self.words.append(before)
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of the minimised acceptor of different words in ascending order."""
        open_states: list[list] = [[False, []]]
        letters: list[str] = []

        def close(depth: int) -> None:
            while len(letters) > depth:
                final, arcs = open_states.pop()
                open_states[-1][1].append((letters.pop(), self.state(final, arcs)))

        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in word[same:]:
                letters.append(letter)
                open_states.append([False, []])
            open_states[-1][0] = True
            last = word
        close(0)
        return self.state(*open_states[0])

    def equal(self, x: int, y: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Numbers of the words that states x and y both accept, from i and j on."""
        work = [(x, y, i, j)]
        while work:
            x, y, i, j = work.pop()
            if x == y:
                yield from ((i + k, j + k) for k in range(self.words[x]))
                continue
            if self.final[x] and self.final[y]:
                yield i, j
            other = self.by_letter[y]
            for letter, child, at in self.arcs[x]:
                if letter in other:
                    second, second_at = other[letter]
                    work.append((child, second, i + at, j + second_at))

    def replaced(self, root: int) -> Iterator[tuple[int, int]]:
        """Pairs of words of one acceptor that differ in one letter."""
        work = [(root, 0)]
        while work:
            x, i = work.pop()
            arcs = self.arcs[x]
            for k, (_, child, at) in enumerate(arcs):
                work.append((child, i + at))
                for _, second, second_at in arcs[k + 1 :]:
                    yield from self.equal(child, second, i + at, i + second_at)

    def inserted(self, short: int, long: int, at_end: bool) -> Iterator[tuple[int, int]]:
        """Pairs of a word and one with a letter more; ``at_end`` allows it behind the last letter."""
        work = [(short, long, 0, 0)]
        while work:
            x, y, i, j = work.pop()
            own = self.by_letter[x]
            for letter, child, at in self.arcs[y]:
                if self.final[x] and self.final[child] and at_end:
                    yield i, j + at
                after = self.by_letter[child]
                for next_letter, (next_x, x_at) in own.items():
                    # before an equal letter the insertion waits until after it
                    if next_letter != letter and next_letter in after:
                        next_y, y_at = after[next_letter]
                        yield from self.equal(next_x, next_y, i + x_at, j + at + y_at)
                if letter in own:
                    next_x, x_at = own[letter]
                    work.append((next_x, child, i + x_at, j + at))


def accepted_pairs(part: str, kind: int, rests: list[str], long: list[bool]) -> Iterator[tuple[int, int]]:
    """Pairs of row numbers that the composition accepts from one initial state."""
    shorter = sorted((r, k) for k, r in enumerate(rests) if not long[k])
    longer = sorted((r, k) for k, r in enumerate(rests) if long[k])
    if kind == REPLACED:
        yield from ((a, b) for n, (_, a) in enumerate(shorter) for _, b in shorter[n + 1 :])
    elif kind == INSERTED:
        yield from ((a, b) for r, a in shorter for s, b in longer if r != s)
    else:
        machine = Acceptors()
        first = machine.add([r for r, _ in shorter])
        yield from ((shorter[i][1], shorter[j][1]) for i, j in machine.replaced(first))
        if longer:
            second = machine.add([r for r, _ in longer])
            yield from ((shorter[i][1], longer[j][1]) for i, j in machine.inserted(first, second, ">" in part.split("/")[0]))


def _linked(part: str, kind: int, rows: list[tuple[str, bool, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, links, count of its best near word, that word) for the words of a partition that have links."""
    rests, long, words, counts = (list(c) for c in zip(*rows))
    links, best = [0] * len(rows), [(0, "")] * len(rows)
    for a, b in accepted_pairs(part, kind, rests, long):
        for own, other in ((a, b), (b, a)):
            links[own] += 1
            # larger counts first, then smaller words
            if not best[own][1] or (-counts[other], words[other]) < (-best[own][0], best[own][1]):
                best[own] = counts[other], words[other]
    yield from ((words[k], links[k], *best[k]) for k in range(len(rows)) if links[k])


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) per word that has near words."""
    rows = advanced(initial_states(words, min_length), group_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        name, group = None, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["word", "links", "best_n", "best"])

        for batch in batches:
            for part, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, kind) != name:
                    if len(group) > 1:
                        out.extend(_linked(*name, group))
                    name, group = (part, kind), []
                group.append(tuple(row))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if len(group) > 1:
            out.extend(_linked(*name, group))
        yield batch_of(out)

    # a partition's rows stand together in a task; partitions are at most group_words long
    dealt = rows.repartition("part", "kind").sortWithinPartitions("part", "kind").select("part", "kind", "rest", "long", "word", "n")
    found = dealt.mapInArrow(run, "word string, links bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("links").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the chain word, form, form's form, ...; counts double along it, so it ends."""
    reached = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("via"), F.col("root").alias("end"))
        # words of one root stand on the left, where a hot root can be split
        step = reached.join(broadcast_if_small(on), F.col("root") == F.col("via"), "left")
        step = materialize(step.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        reached = step.drop("moved")
        if step.filter("moved").isEmpty():
            return reached


def variant_groups(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, group_words: int = GROUP_WORDS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary."""
    words = materialize(vocabulary(df, key, text, min_length, min_count))
    beside = words.join(near_words(words, min_length, group_words), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    named = materialize(
        beside.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")
        )
    )
    roots = with_roots(named.filter(F.col("form").isNotNull()))
    whole = named.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, its root and how many words are near it."""
    return variant_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS mark, run, count(*) AS n, length(run) AS len FROM runs GROUP BY ALL),
bytes AS (
  SELECT mark, 0 AS place, flatten(list_transform(string_split(mark, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b,
    4294967295 AS c FROM counted
  UNION ALL
  SELECT mark, place + 1, b, xor(c >> 8, v) FROM bytes JOIN crc ON crc.i = xor(c, b[place + 1]) & 255 WHERE place < len(b)),
marks AS (SELECT mark, xor(c, 4294967295) AS h FROM bytes WHERE place = len(b)),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len AS INTEGER)) || substr(run, CAST(h % len AS INTEGER) + 2) ELSE run END AS word, n FROM counted JOIN marks USING (mark)),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) t(p)),
links AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n, first(near ORDER BY n DESC, near) AS form FROM links GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
