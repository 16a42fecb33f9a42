"""Secret scans: fixed credential patterns, and assignments lexed into name-literal pairs.

Every text is read whole by one call of :func:`scan`.  Two kinds of findings:

* the base kinds ``assign``, ``access`` and ``hex``: leftmost matches of three
  patterns, each kind on its own;
* the kind ``literal``: the text is lexed around its assignment operators
  (``=``, ``:``, ``:=``, ``=>`` of source code, JSON, YAML, property and shell
  files, and the ``key``/``name`` .. ``value`` attribute pairs of XML).  Each
  assignment gives a target name and an expression of literals and names.
  Names stand for the constants they were last given, through any number of
  steps and through ``+``, also as ``$NAME``, ``${NAME}`` and ``{NAME}`` alone or
  inside a string.  A literal is scored by the most sensitive name it
  reaches times how much it looks like a credential, and reported from
  :data:`THRESHOLD` on.

A null or empty text has no findings.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, table

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Last words of a target name, and how surely they name a credential.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 0.8,
    "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7,
    "bearer": 0.8, "signature": 0.6, "salt": 0.6, "pin": 0.5,
}
#: Words before ``key`` that make it a credential.
KEY_OWNERS = {"api", "access", "secret", "private", "encryption", "signing", "master", "auth", "account", "storage", "shared"}
#: Literals that stand for a credential without being one.
PLACEHOLDER = re.compile(
    r"(?i)(your|my|insert|enter|todo|example|sample|dummy|fake|placeholder|change_?me|redacted|none|null|undefined|true|false|required|optional|string|str|text|password|passwd|secret|token)[\w .-]*|[x*.#?_-]+|[<\[{%].*[>\]}%]|\$.*"
)
OPERATOR = re.compile(r":=|=>|[=:]")
STRING = re.compile(
    r"(?:[fFrRbBuU]{1,2}(?=[\"']))?(?:\"\"\"(?P<t>(?:[^\\]|\\[\s\S])*?)\"\"\"|'\'\'(?P<u>(?:[^\\]|\\[\s\S])*?)'\'\'"
    r"|\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)"
)
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*(?![\w(\[])", re.ASCII)
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
#: $NAME and ${NAME} (of shells, properties and templates), and {NAME} of format strings.
REFERENCE = re.compile(r"\$([A-Za-z_]\w*)|\$?\{\{?[ \t]*([A-Za-z_$][\w$.-]*)[ \t]*(?::?[-=?+!:][^{}\n]*)?\}", re.ASCII)
BARE_REFERENCES = re.compile(r"(?:\$\{[^{}\n]*\}|[^\s\"'`,;(){}\[\]<>])+")
PLUS = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'$]))[ \t]*")
BLANKS = re.compile(r"[ \t]*")
#: Brackets around values, and conversions to text; commas between the values of a list; alternatives to a missing value.
OPENING = re.compile(r"(?:(?:str|bytes|String)\(|[(\[])[ \t\n]*")
CLOSING = re.compile(r"[ \t\n]*[)\]]")
COMMA = re.compile(r"[ \t\n]*,[ \t\n]*(?=[\"'`])")
ELSE = re.compile(r"[ \t]*(?:\|\||\?\?|\bor\b)[ \t]*(?=[\"'`(A-Za-z_$])")
ELEMENT = re.compile(r"<([A-Za-z][\w.-]*)>([^<>\n]+)</\1>", re.ASCII)
DEFINED = re.compile(r"\b(?:define|setenv|putenv|setProperty)\([ \t]*[\"']([\w.-]+)[\"'][ \t]*,[ \t]*(?:\"([^\"\n]+)\"|'([^'\n]+)')", re.ASCII)
ATTRIBUTES = re.compile(
    r"\b(?:key|name)[ \t]*=[ \t]*(?:\"([\w.-]+)\"|'([\w.-]+)')(?:[ \t]+value[ \t]*=[ \t]*(?:\"([^\"\n]*)\"|'([^'\n]*)')|[ \t]*>([^<\n]*)<)", re.ASCII
)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$")
DOTTED_CHARS = NAME_CHARS | frozenset(".-")
TYPE_CHARS = (NAME_CHARS - {"$"}) | frozenset("[]<>., |?")
FIRST_CHARS = NAME_CHARS - frozenset("0123456789")
BLANK_CHARS = frozenset(" \t")


class Span(NamedTuple):
    start: int
    end: int
    kind: str

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def name_score(name: str) -> float:
    """How surely a target of this name holds a credential; decided by its last words."""
    words = [w.lower() for w in WORD.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return 0.0
    if words[-1] == "key" and len(words) > 1:
        return 1.0 if words[-2] in KEY_OWNERS else 0.3
    return SENSITIVE.get(words[-1], 0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a credential: length, mix of characters, entropy."""
    if len(value) < 6 or PLACEHOLDER.fullmatch(value) or value.startswith(("http://", "https://")):
        return 0.0
    if re.search(r"\s", value) and len(value.split()) > 4:
        return 0.2
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 3) * (0.6 + 0.2 * min(2, classes - 1))


class Assignment(NamedTuple):
    """A target name with the literals and the earlier assignments that its expression is made of."""

    name: str
    literals: list[tuple[int, int]]
    uses: list[int]


def _interpolated(text: str, start: int, end: int, known: dict[str, int]) -> tuple[list[tuple[int, int]], list[int]] | None:
    """The pieces of a value between references to known names, and what these are; None if it has none."""
    literals: list[tuple[int, int]] = []
    uses: list[int] = []
    for m in REFERENCE.finditer(text, start, end):
        used = known.get(m[1] or m[2])
        if used is not None:
            if m.start() > start:
                literals.append((start, m.start()))
            uses.append(used)
            start = m.end()
    if not uses:
        return None
    if end > start:
        literals.append((start, end))
    return literals, uses


def _expression(text: str, at: int, known: dict[str, int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Literals and used assignments of the expression at ``at``: values joined, listed in brackets, or given as alternatives."""
    literals: list[tuple[int, int]] = []
    uses: list[int] = []
    start, depth = at, 0
    while True:
        while m := OPENING.match(text, at):
            at, depth = m.end(), depth + 1
        if m := STRING.match(text, at):
            span = m.span(m.lastgroup)
            more = _interpolated(text, *span, known) or ([span], [])
            literals.extend(more[0])
            uses.extend(more[1])
        elif (m := NAME.match(text, at)) and m[0] in known:
            uses.append(known[m[0]])
        elif m and ELSE.match(text, m.end()):
            pass  # a name of nothing known, with an alternative
        else:
            # a bare value of a configuration line ends the expression
            if not literals and not uses and at == start:
                if (m := BARE_REFERENCES.match(text, at)) and (more := _interpolated(text, *m.span(), known)):
                    return more
                if m := BARE.match(text, at):
                    literals.append(m.span())
            return literals, uses
        at = m.end()
        while depth and (m := CLOSING.match(text, at)):
            at, depth = m.end(), depth - 1
        following = PLUS.match(text, at) or ELSE.match(text, at) or (COMMA.match(text, at) if depth else None)
        if not following:
            return literals, uses
        at = following.end()


def _back(text: str, at: int, chars: frozenset[str]) -> int:
    """The start of the run of such characters that ends at ``at``."""
    while at > 0 and text[at - 1] in chars:
        at -= 1
    return at


def _name_before(text: str, at: int, chars: frozenset[str]) -> str | None:
    """The name that ends at ``at``; it begins with a letter, underscore or dollar sign."""
    start = _back(text, at, chars)
    while start < at and text[start] not in FIRST_CHARS:
        start += 1
    return text[start:at] or None


def _target(text: str, at: int) -> str | None:
    """What an operator assigns to: a name with an optional type, or a key in quotes and brackets.

    Reads backwards, at most to the operator before, so that all targets of a
    text take one walk through it.
    """
    end = _back(text, at, BLANK_CHARS)
    typed = _back(text, end, TYPE_CHARS)
    while typed < end and text[typed] == " ":
        typed += 1
    colon = _back(text, typed, BLANK_CHARS)
    if typed < end and text[typed] in FIRST_CHARS and colon and text[colon - 1] == ":":
        if name := _name_before(text, _back(text, colon - 1, BLANK_CHARS), NAME_CHARS):
            return name
    closed = 0
    while closed < 3 and end > 0 and text[end - 1] in "\"'])":
        end -= 1
        closed += 1
    return _name_before(text, end, DOTTED_CHARS)


def assignments(text: str) -> list[Assignment]:
    """All assignments in order; a name stands for the last one to it."""
    known: dict[str, int] = {}
    found: list[Assignment] = []
    if not any(c in text for c in ":=<("):
        return found
    for m in OPERATOR.finditer(text):
        if text[m.start() - 1 : m.start()] in ("=", "!", "<", ">", ":") and m.start() or text[m.end() : m.end() + 1] == "=":
            continue  # a comparison or a scope
        name = _target(text, m.start())
        if name is None:
            continue
        literals, uses = _expression(text, BLANKS.match(text, m.end()).end(), known)
        if literals or uses:
            known[name] = len(found)
            found.append(Assignment(name, literals, uses))
    for m in ATTRIBUTES.finditer(text):
        group = next((g for g in (3, 4, 5) if m[g]), None)
        if group:
            found.append(Assignment(m[1] or m[2], [m.span(group)], []))
    found.extend(Assignment(m[1], [m.span(2)], []) for m in ELEMENT.finditer(text))
    found.extend(Assignment(m[1], [m.span(2 if m[2] else 3)], []) for m in DEFINED.finditer(text))
    return found


def lexed(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach a sensitive target and look like a credential.

    Uses point backwards, so one pass from the last assignment to the first
    carries every target's sensitivity to all constants that it is made of.
    """
    found = assignments(text)
    reached = [name_score(a.name) for a in found]
    best: dict[tuple[int, int], float] = {}
    for i in range(len(found) - 1, -1, -1):
        if sensitive := reached[i]:
            for used in found[i].uses:
                reached[used] = max(reached[used], sensitive)
            for place in found[i].literals:
                best[place] = max(sensitive, best.get(place, 0.0))
    return [Span(*place, "literal") for place, s in sorted(best.items()) if s * literal_score(text[place[0] : place[1]]) >= threshold]


def base(text: str) -> list[Span]:
    """Findings of the three patterns; each pattern's own matches do not overlap."""
    found = []
    if ":" in text or "=" in text:
        found += [Span(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span(*m.span(), "access") for m in ACCESS.finditer(text)]
    return found + [Span(*m.span(), "hex") for m in HEX.finditer(text)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All findings of a whole text, by start and then kind."""
    return ordered(base(text or "") + lexed(text or "", threshold))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, findings) per row; findings are (kind, start, end, value), empty for a null text.

    One pass over the rows, no shuffle.  Repeated rows each get their own
    result; other columns of ``df`` are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(k, t):
        return k, [(s.kind, s.start, s.end, t[s.start : s.end]) for s in scan(t, threshold)]

    return map_rows(
        df.select(F.col(key), F.col(text)),
        run,
        f"`{key}` {kind}, findings array<struct<kind:string,start:bigint,end:bigint,value:string>>",
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document as counts, a digest of the base ones, and all spans as text."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")

    def joined(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("findings", lambda f: f["kind"] != "literal")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
