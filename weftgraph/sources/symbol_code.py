"""Symbols of languages other than Python: classes, functions and methods with their spans and hashes.

Declarations are read off tokens and their brackets. In languages with braces a declaration ends with its body,
or where the expression ends that is its body; in Ruby at the ``end`` of its block. A symbol inside a class,
module or other container carries its name in front; one with decorators or annotations starts there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import read_files
from .lexing import MARK, WORD, Code
from .script_code import Lines

SCHEMA = "repo string, file string, fact string, line int, line_end int, name string, method string, framework string, extra string, reason string"
#: Sources above so many bytes give one skipped row instead of symbols.
MOST_BYTES = 2_000_000
#: Words in front of a bracket that are no names of functions.
NO_NAME = frozenset("if for while switch catch return function new else do try await typeof throw using lock when super this match loop unless foreach elseif sizeof synchronized fixed with delete void yield case in of instanceof import".split())
#: Words in front of a name that are no type.
NO_TYPE = NO_NAME - {"void"} | frozenset("is as goto not and or out".split())
MODIFIERS = frozenset("public private protected internal static final abstract override virtual async sealed partial export default readonly open suspend inline pub unsafe const extern data declare get set crate annotation inner enum value companion operator infix tailrec external".split())
CONTAINERS = ("class", "interface", "struct", "trait", "module", "enum", "impl", "object", "record")
#: Marks with which a line goes on from the one before.
GOES_ON = frozenset(". ?. ? : && || + - * / | & = => -> < > % == === != , :: &.".split())


@dataclass
class Symbol:
    """A declaration from its first to its last token."""

    name: str
    kind: str
    start: int
    end: int
    qualname: str = ""


def expression_end(c: Code, i: int) -> int:
    """Last token of the expression that begins at ``i``: up to a semicolon, a comma, a closing bracket or a line that does not go on."""
    j = i
    while j < len(c.tokens):
        x = c.at(j)
        if x == ";":
            return j
        if x in (",", ")", "]", "}") or (j > i and c.first(j) and x not in GOES_ON and c.at(j - 1) not in GOES_ON):
            return j - 1
        j = c.skip(j)
    return len(c.tokens) - 1


def body_of(c: Code, i: int, by_line: bool = False) -> int | None:
    """The brace that opens the body of what is declared up to ``i``; None if a semicolon, a closing bracket or (``by_line``) a new line comes first."""
    while i < len(c.tokens):
        x = c.at(i)
        if x == "{":
            return i
        if x in (";", "}", ")", "]") or (by_line and c.first(i) and x not in GOES_ON and c.at(i - 1) not in GOES_ON):
            return None
        i = c.generics(i) if x == "<" and c.generics(i) > i else c.skip(i)
    return None


def head(c: Code, i: int) -> int:
    """First token of a declaration: its modifiers and decorators."""
    while True:
        if c.at(i - 1) in MODIFIERS or (c.at(i - 1) == ")" and c.at(c.match.get(i - 1, 0) - 1) == "pub"):
            i = c.match[i - 1] - 1 if c.at(i - 1) == ")" else i - 1
            continue
        k = c.match.get(i - 1, 0) - 1 if c.at(i - 1) == ")" else i - 1
        while c.is_word(k) and c.at(k - 1) == ".":
            k -= 2
        if not (c.is_word(k) and c.at(k - 1) == "@"):
            return i
        i = k - 1


def statement(c: Code, i: int) -> int:
    """First token behind the semicolon or brace in front of ``i``."""
    while i > 0 and c.at(i - 1) not in (";", "{", "}"):
        i = c.match.get(i - 1, i - 1) if c.at(i - 1) in (")", "]") else i - 1
    return i


def types(c: Code, words: tuple[str, ...], first: Callable[[Code, int], int], by_line: bool = False) -> Iterator[Symbol]:
    """Classes and their like, by the word in front of their name; one without a body ends with its line or semicolon."""
    for i in range(len(c.tokens)):
        word = c.at(i)
        if word not in words or not c.is_word(i) or c.at(i - 1) in (".", "?.", "::", "new") or not c.is_word(i + 1) or c.at(i + 1) in (*words, "extends", "implements"):
            continue
        after = c.generics(i + 2)
        if c.at(after) not in ("{", "(", ":", ";", "where", "extends", "implements", "permits", "with", "private", "public", "internal", "") and not (by_line and c.first(after)) and c.tokens[i + 1].kind == WORD and c.at(after) != "}":
            continue
        if word == "record" and c.at(after) not in ("(", "{", ":", ";"):
            continue
        body = body_of(c, after, by_line)
        if body is not None:
            yield Symbol(c.at(i + 1), word, first(c, i), c.match.get(body, len(c.tokens) - 1))
        elif c.at(after) in ("(", ";", ":") or by_line:
            end = expression_end(c, i + 1)
            yield Symbol(c.at(i + 1), word, first(c, i), max(end, i + 1))


def annotated(c: Code, i: int) -> int:
    """Behind a type after a colon, up to what cannot belong to one; braces of object types are jumped."""
    while i < len(c.tokens):
        x = c.at(i)
        if x == "{" and c.at(i - 1) not in (":", "|", "&", "=>", "<", ","):
            return i
        if x in (";", "=", ",", ")", "]", "}"):
            return i
        i = c.generics(i) if x == "<" and c.generics(i) > i else c.skip(i)
    return i


def scripts(c: Code) -> Iterator[Symbol]:
    """JavaScript and TypeScript: types, functions, methods of classes and objects, functions bound to names."""
    yield from types(c, ("class", "interface", "enum"), head)
    for i in range(len(c.tokens)):
        word = c.at(i)
        if not c.is_word(i) and word != "function":
            continue
        if word == "function":
            name = i + 1 + (c.at(i + 1) == "*")
            if not c.is_word(name) or c.at(c.generics(name + 1)) != "(":
                continue
            j = c.skip(c.generics(name + 1))
            j = annotated(c, j + 1) if c.at(j) == ":" else j
            if c.at(j) == "{":
                yield Symbol(c.at(name), "function", head(c, i), c.match.get(j, len(c.tokens) - 1))
        elif word in ("const", "let", "var") and c.is_word(i + 1):
            j = i + 2
            while c.at(j) == ":" or (c.at(i + 2) == ":" and j < len(c.tokens) and c.at(j) not in ("=", ";", ",")):
                j = c.generics(j) if c.generics(j) > j else c.skip(j)
            if c.at(j) != "=":
                continue
            j += 1 + (c.at(j + 1) == "async")
            if c.at(j) == "function":
                body = body_of(c, j + 1)
                if body is not None:
                    yield Symbol(c.at(i + 1), "function", head(c, i), c.match.get(body, len(c.tokens) - 1))
                continue
            j = c.generics(j)
            j = c.skip(j) if c.at(j) == "(" or c.is_word(j) else j
            while c.at(j) == ":" or (c.at(j) not in ("=>", ";", ",", "=", "") and c.at(j - 1) == ":") or c.at(j) in ("|", "&", ".") or (c.at(j - 1) in ("|", "&", ".") and j < len(c.tokens)):
                j = c.generics(j + 1) if c.is_word(j) else c.skip(j)
            if c.at(j) == "=>":
                yield Symbol(c.at(i + 1), "function", head(c, i), c.match.get(j + 1, len(c.tokens) - 1) if c.at(j + 1) == "{" else expression_end(c, j + 1))
        elif word not in NO_NAME and c.at(i - 1) not in (".", "?.", "function", "new", "=", "=>", ":", "?", "return", "await") and not (c.at(i - 1) == "*" and c.at(i - 2) == "function"):
            j = c.generics(i + 1)
            if c.at(j) != "(":
                continue
            j = c.skip(j)
            j = annotated(c, j + 1) if c.at(j) == ":" else j
            if c.at(j) == "{" and j > 0 and c.at(j - 1) != "=>":
                yield Symbol(word, "method", head(c, i - (c.at(i - 1) == "*")), c.match.get(j, len(c.tokens) - 1))


def go(c: Code) -> Iterator[Symbol]:
    """Functions, methods (with the receiver's type in front) and types, also several in one bracket."""
    for i in range(len(c.tokens)):
        if c.at(i) == "func":
            j, owner = i + 1, ""
            if c.at(j) == "(" and c.is_word(c.skip(j)):
                words = [k for k in range(j + 1, c.match.get(j, j)) if c.is_word(k) and c.around[k] == c.around[i]]
                plain = [k for k in words if c.at(k - 1) not in ("[", ",") or k == j + 1]
                owner, j = c.at(plain[min(1, len(plain) - 1)]) if plain else "", c.skip(j)
            if not c.is_word(j):
                continue
            name, j = c.at(j), j + 1
            j = c.skip(j) if c.at(j) == "[" else j
            if c.at(j) != "(":
                continue
            j = c.skip(j)
            while c.at(j) not in ("{", "", ";") and not c.first(j) or (c.at(j) == "{" and c.at(j - 1) in ("interface", "struct")):
                j = c.skip(j)
            if c.at(j) == "{":
                yield Symbol(f"{owner}.{name}" if owner else name, "method" if owner else "function", i, c.match.get(j, len(c.tokens) - 1))
        elif c.at(i) == "type" and c.first(i):
            names = [k for k in range(i + 2, c.match.get(i + 1, i)) if c.first(k) and c.is_word(k) and c.around[k] == c.around[i]] if c.at(i + 1) == "(" else [i + 1]
            for k in names:
                j = c.skip(k + 1) if c.at(k + 1) == "[" else k + 1
                if c.at(j) in ("struct", "interface") and c.at(j + 1) == "{":
                    yield Symbol(c.at(k), c.at(j), i if len(names) == 1 and k == i + 1 else k, c.match.get(j + 1, len(c.tokens) - 1))


def typed(c: Code, words: tuple[str, ...]) -> Iterator[Symbol]:
    """Java and C#: types, and what stands directly in their bodies as ``type name(...)`` or as a constructor."""
    bodies: dict[int, str] = {}
    for s in types(c, words, statement):
        opening = c.match.get(s.end, -1)
        if c.at(s.end) == "}":
            bodies[opening] = s.name
        yield s
    for i in range(len(c.tokens)):
        if not c.is_word(i) or c.around[i] not in bodies or c.at(i) in NO_NAME or c.at(c.generics(i + 1)) != "(":
            continue
        p = i - 1
        while c.at(p) == "." and c.is_word(p - 1):
            p -= 2
        own = c.at(i) == bodies[c.around[i]]
        if not ((c.is_word(p) and c.at(p) not in NO_TYPE and c.at(p) not in words and c.at(p - 1) != "@") or c.at(p) in (">", "]", "?", "*", "~") or (own and c.at(p) in ("{", "}", ";", ")"))):
            continue
        j = c.skip(c.generics(i + 1))
        while c.at(j) not in ("{", ";", "=>", "}", "=", ""):
            j = c.generics(j) if c.generics(j) > j else c.skip(j)
        if c.at(j) in ("{", ";", "=>"):
            yield Symbol(c.at(i), "method", statement(c, p + 1), c.match.get(j, len(c.tokens) - 1) if c.at(j) == "{" else expression_end(c, j + 1) if c.at(j) == "=>" else j)


def kotlin(c: Code) -> Iterator[Symbol]:
    """Types and functions, also extension functions and such with an expression for a body."""
    yield from types(c, ("class", "interface", "object"), head, by_line=True)
    for i in range(len(c.tokens)):
        if c.at(i) != "fun" or c.at(i + 1) == "interface":
            continue
        j = c.generics(i + 1)
        while c.is_word(j) or c.at(j) in (".", "?", "?.") or c.generics(j) > j:
            j = c.generics(j) if c.generics(j) > j else j + 1
        if c.at(j) != "(" or not c.is_word(j - 1):
            continue
        name, j = c.at(j - 1), c.skip(j)
        end = j - 1
        if c.at(j) == ":":
            j += 1
            while c.at(j) not in ("{", "=", "}", ";", "") and (not c.first(j) or c.at(j - 1) in GOES_ON):
                j = c.generics(j) if c.generics(j) > j else c.skip(j)
            end = j - 1
        if c.at(j) == "{":
            end = c.match.get(j, len(c.tokens) - 1)
        elif c.at(j) == "=":
            end = expression_end(c, j + 1)
        yield Symbol(name, "function", head(c, i), end)


def rust(c: Code) -> Iterator[Symbol]:
    """Types, functions, and ``impl`` blocks under the name of the type that they are for."""
    yield from types(c, ("struct", "enum", "trait"), head)
    for i in range(len(c.tokens)):
        if c.at(i) == "fn" and c.is_word(i + 1):
            body = body_of(c, i + 2)
            if body is not None:
                yield Symbol(c.at(i + 1), "function", head(c, i), c.match.get(body, len(c.tokens) - 1))
        elif c.at(i) == "impl" and (c.first(i) or c.at(i - 1) in ("unsafe", "}", ";", "]", "{")):
            j, name = c.generics(i + 1), ""
            while j < len(c.tokens) and c.at(j) not in ("{", ";", "where"):
                if c.at(j) == "for":
                    name = ""
                elif c.is_word(j) and c.at(j) not in ("dyn", "mut", "const") and not c.at(j).startswith("'") and (not name or c.at(j - 1) == "::"):
                    name = c.at(j)
                j = c.generics(j) if c.generics(j) > j else c.skip(j)
            body = body_of(c, j)
            if body is not None and name:
                yield Symbol(name, "impl", i, c.match.get(body, len(c.tokens) - 1))


def php(c: Code) -> Iterator[Symbol]:
    """Types and functions, abstract ones too."""
    yield from types(c, ("class", "interface", "trait", "enum"), head)
    for i in range(len(c.tokens)):
        name = i + 1 + (c.at(i + 1) == "&")
        if c.at(i) == "function" and c.is_word(name) and c.at(name + 1) == "(":
            j = c.skip(name + 1)
            body = body_of(c, j)
            end = c.match.get(body, len(c.tokens) - 1) if body is not None else expression_end(c, j)
            yield Symbol(c.at(name), "function", head(c, i), end)


def ruby(c: Code) -> Iterator[Symbol]:
    """Blocks by their ``end``: modules, classes and methods, also those defined by an expression."""
    stack: list[Symbol | None] = []
    loop, i = False, -1
    while (i := i + 1) < len(c.tokens):
        word, before = c.at(i), c.at(i - 1)
        loop = loop and not c.first(i)
        if not c.is_word(i) or (before in (".", "&.", "::") and not c.first(i)):
            continue
        leads = c.first(i) or (i > 0 and c.tokens[i - 1].kind == MARK and before not in (")", "]", "}")) or before in ("then", "else", "do", "begin", "ensure") or i == 0
        if word in ("class", "module", "def"):
            j = i + 1
            if word == "class" and c.at(j) == "<<":
                stack.append(None)
                continue
            while (c.is_word(j) or word == "def") and c.at(j + 1) == ("." if word == "def" else "::"):
                j += 2
            name = c.at(j) or c.tokens[j].said if j < len(c.tokens) else ""
            while word == "def" and not c.is_word(j) and j + 1 < len(c.tokens) and c.tokens[j + 1].start == c.tokens[j].end and c.at(j + 1) not in ("(", "", ";"):  # operators
                j += 1
                name += c.at(j)
            if word != "def":
                name = c.slice(i + 1, j + 1)
            elif c.at(j + 1) == "=" and c.tokens[j + 1].start == c.tokens[j].end and c.at(j + 2) == "(":
                name, j = name + "=", j + 1
            found = Symbol(name, {"def": "function"}.get(word, word), i, i)
            after = c.skip(j + 1) if c.at(j + 1) == "(" else j + 1
            if word == "def" and c.at(after) == "=" and not c.first(after):
                found.end = expression_end(c, after + 1)
                yield found
            else:
                stack.append(found)
            i = j
        elif word in ("if", "unless", "while", "until") and leads or word in ("case", "begin", "for") and c.tokens[i].kind == WORD:
            stack.append(None)
            loop = word in ("while", "until", "for")
        elif word == "do":
            if not loop:
                stack.append(None)
            loop = False
        elif word == "end" and stack:
            if done := stack.pop():
                done.end = i
                yield done


#: Per suffix the language and what reads its declarations.
LANGUAGES: dict[str, tuple[str, Callable[[Code], Iterator[Symbol]]]] = {
    **dict.fromkeys((".js", ".jsx", ".mjs", ".cjs"), ("javascript", scripts)), **dict.fromkeys((".ts", ".tsx"), ("typescript", scripts)),
    ".go": ("go", go), ".java": ("java", lambda c: typed(c, ("class", "interface", "enum", "record"))),
    ".cs": ("csharp", lambda c: typed(c, ("class", "interface", "enum", "record", "struct"))),
    ".kt": ("kotlin", kotlin), ".rs": ("rust", rust), ".php": ("php", php), ".rb": ("ruby", ruby),
}


def symbols_of(path: str, text: str) -> list[tuple[Symbol, int, int]]:
    """Symbols of one file with their full names and offsets, by place; at one place the first that was found."""
    language, read = LANGUAGES["." + path.rsplit(".", 1)[-1]]
    code = Code(text, language)
    if not code.tokens:
        return []
    found: dict[tuple[int, str], Symbol] = {}
    for s in read(code):
        found.setdefault((s.start, s.name), s)
    open_: list[Symbol] = []
    out = []
    for s in sorted(found.values(), key=lambda s: (s.start, -s.end)):
        while open_ and open_[-1].end < s.start:
            open_.pop()
        holder = open_[-1] if open_ else None
        s.qualname = f"{holder.qualname}.{s.name}" if holder else s.name
        if s.kind in ("function", "method") and "." not in s.name:
            s.kind = "method" if holder and holder.kind in CONTAINERS else "function"
        open_.append(s)
        if s.kind != "impl":
            out.append((s, code.tokens[s.start].start, code.tokens[s.end].end - 1))
    return out


def read_symbols(files: DataFrame) -> DataFrame:
    """files(repo, path, content) -> facts of kind ``symbol``."""
    def read(repo: str, path: str, content: bytes) -> list[dict]:
        if len(content) > MOST_BYTES:
            return [{"repo": repo, "file": path, "fact": "skipped", "line": 0, "line_end": 0, "reason": "too-large"}]
        text = content.decode("utf-8", "replace")
        at, lines, out = Lines(text), text.split("\n"), []
        for s, start, end in symbols_of(path, text):
            first, last = at.at(start), at.at(end)
            body = "\n".join(x.rstrip("\r") for x in lines[first - 1 : last])
            out.append({"repo": repo, "file": path, "fact": "symbol", "line": first, "line_end": last, "name": s.qualname, "method": s.kind, "extra": hashlib.sha1(body.encode("utf-8", "replace")).hexdigest()[:12]})
        return out

    suffixes = "|".join(s[1:] for s in LANGUAGES)
    wanted = F.col("path").rlike(rf"\.({suffixes})$") & ~F.col("path").rlike(r"(\.d\.ts|\.min\.\w+)$")
    return read_files(files.filter(wanted), SCHEMA, read)
