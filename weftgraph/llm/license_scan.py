"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser
evaluates the and/or/with expressions behind the tags."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .work import python_stage, only

#: Notice phrases and their labels (fixed values of the contract).
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "boost software license": "boost",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit-style",
    "all rights reserved": "reserved", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
}
TAGS = ("spdx license identifier",)
#: Families of identifiers, longest prefix first, and whether their terms are permissive.
FAMILIES = (
    ("cc-by-nc", "cc-by-nc", False), ("cc-by-nd", "cc-by-nd", False), ("cc-by-sa", "cc-by-sa", False), ("cc-by", "cc-by", True), ("cc0", "cc0", True),
    ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("apache", "apache", True), ("mit", "mit", True), ("bsd", "bsd", True),
    ("isc", "isc", True), ("mpl", "mpl", False), ("epl", "epl", False), ("bsl", "boost", True), ("unlicense", "public-domain", True),
)
OPEN_LABELS = {"apache", "cc-by", "mit", "bsd", "isc", "boost", "cc0", "public-domain", "mit-style"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Bytes outside the words become a space, A-Z lower case; bytes from 0x80 on belong to words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permissive boolean"
TOKEN = re.compile(r"[()]|[^\s()]+")
OPERAND = re.compile(r"[A-Za-z0-9][A-Za-z0-9.:+-]*")
#: Blanks and colons behind a tag; tokens up to the end of the line.
BEFORE, LINE_TOKEN = re.compile(r"[^\S\n]*:*"), re.compile(r"\n|[()]|[^\s()]+")
COMMENT_END = re.compile(r"\*/|-->")


def well_formed(tokens: Iterable[str]) -> list[str]:
    """The longest well-formed prefix of the tokens, in one pass that ends at the first token that fits nowhere."""
    seen: list[str] = []
    operand, depth, last = False, 0, 0
    for token in tokens:
        low = token.lower()
        if low == "(":
            if operand:
                break
            depth += 1
        elif low == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif low in PRECEDENCE:
            if not operand:
                break
            operand = False
        elif operand or not OPERAND.fullmatch(token):
            break
        else:
            operand = True
        seen.append(token)
        if operand and not depth:
            last = len(seen)
    return seen[:last]


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in evaluation order; None if the expression is malformed."""
    tokens = TOKEN.findall(expression)
    if not tokens or len(well_formed(tokens)) < len(tokens):
        return None
    out: list[str] = []
    stack: list[str] = []
    for token in tokens:
        low = token.lower()
        if low == "(":
            stack.append(low)
        elif low == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
        else:
            out.append(token)
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels of all operands, and whether a licensee can choose permissive terms throughout."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (b, q), (a, p) = stack.pop(), stack.pop()
            if token != "with":
                a, b = (a, b) if len(a) > len(b) else (b, a)
                a |= b
                p = p or q if token == "or" else p and q
            stack.append((a, p))
        else:
            low = token.lower()
            family = next(((label, free) for prefix, label, free in FAMILIES if low.startswith(prefix)), (f"id:{low.rstrip('+')}", False))
            stack.append(({family[0]}, family[1]))
    return stack[-1]


def tag_expression(text: str, at: int) -> str:
    """What stands behind a tag: to the end of the line, without comment ends; the longest well-formed prefix."""

    def tokens() -> Iterator[str]:
        for m in LINE_TOKEN.finditer(text, BEFORE.match(text, at).end()):
            if m[0] == "\n":
                return
            if end := COMMENT_END.search(m[0]):
                if end.start():
                    yield m[0][: end.start()]
                return
            yield m[0]

    return " ".join(well_formed(tokens()))


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *MORE_PHRASES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, automaton) -> tuple:
    """n_words, places of base phrases, base labels, all labels, score, expression, permissive of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, tags = [], set(), set(), 0
    counted, blanks = 0, 0  # hits come by their ends and no phrase is long, so the count of blanks hardly ever goes back
    for end, phrase in automaton.iter(line):
        if phrase in BASE_PHRASES:
            at = end - len(phrase)
            blanks += line.count(" ", counted, at) if at >= counted else -line.count(" ", at, counted)
            counted = at
            starts.append(blanks - 1)
            base.add(BASE_PHRASES[phrase])
        elif phrase in MORE_PHRASES:
            labels.add(MORE_PHRASES[phrase])
        else:
            tags += 1
    expressions, free = [], []
    if tags:
        for m in re.finditer(r"spdx[^0-9A-Za-z\u0080-\U0010FFFF]+license[^0-9A-Za-z\u0080-\U0010FFFF]+identifier(?![0-9A-Za-z\u0080-\U0010FFFF])", text, re.IGNORECASE | re.ASCII):
            if expression := tag_expression(text, m.end()):
                found, permissive = evaluate(to_postfix(expression))
                labels |= found
                expressions.append(expression)
                free.append(permissive)
    notices = base | labels
    permissive = all(free) if free else bool(notices) and notices <= OPEN_LABELS
    score = 1.0 if expressions else 0.0 if not notices else min(0.95, 0.5 + 0.15 * len(starts) + 0.1 * len(notices))
    return len(words), starts, base, notices, score, " ; ".join(expressions) or None, permissive if notices else None


def scan_licenses(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: the columns of ``SCHEMA``.

    Null and empty texts have no words, labels are then empty and the score 0. Where phrases overlap or
    tie in a place each counts. A text of any length is read in one pass. A malformed expression is cut to its longest well-formed prefix. Every row gives one row;
    an empty table an empty result. Other columns are not read.
    """
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out: dict[str, list] = {n.split()[0]: [] for n in SCHEMA.split(", ")}
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, starts, base, labels, score, expression, permissive = scan(value.as_py() or "", automaton)
                row = (doc, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, expression, permissive)
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(out.values(), SCHEMA.split(", "), strict=True)], names=list(out))

    return only(docs, id, text).mapInArrow(run, SCHEMA)
