"""Tokens of the languages whose symbols and calls are read: a tokenizer with a stack of modes.

Inside a string that may hold code (templates, interpolation) the tokenizer goes back to code until the brace
that closes it, to any depth; such a string is one token, with its computed parts as ``{}``. Regular expression
literals, raw strings, here documents, lifetimes and nested comments are told from what looks like them by the
token in front. Comments give no token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD, TEXT, NUMBER, MARK = "word", "text", "number", "mark"
SLASHES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
MARKS = r"=>|->|::|\?\.|&\.|\.\.\.|[=!]==?|<=|&&|\|\||<<|."
NAME = r"[^\W\d]\w*"
#: A string: what opens it, what closes it ({0} is the opening's group), escapes by backslash, what opens code inside, may go over lines.
Form = tuple[str, str, bool, str, bool]
PLAIN: tuple[Form, ...] = ((r'"', '"', True, "", False), (r"'", "'", True, "", False))


@dataclass(frozen=True)
class Grammar:
    forms: tuple[Form, ...]
    comments: str = SLASHES
    name: str = NAME
    #: Words after which a slash begins a regular expression; None: the language has no such literals.
    regex_after: frozenset[str] | None = None
    #: Here documents: what opens one, with groups for its name; its last line is that name.
    here: str = ""
    nested_comments: bool = False


_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else await yield if unless while until and or not when then elsif puts".split())
_JS = Grammar((*PLAIN, (r"`", "`", True, "${", True)), name=r"#?[^\W\d][\w$]*|\$[\w$]*", regex_after=_BEFORE_REGEX)
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
GRAMMARS = {
    "javascript": _JS, "typescript": _JS,
    "go": Grammar((*PLAIN, (r"`", "`", False, "", True))),
    "java": Grammar(((r'"""', '"""', True, "", True), *PLAIN)),
    "kotlin": Grammar(((r'"""', '"""', False, "${", True), (r'"', '"', True, "${", False), PLAIN[1]), name=NAME + r"|`[^`\n]+`", nested_comments=True),
    "csharp": Grammar(((r'(?:\$@|@\$)"', '"', False, "{", True), (r'@"', '"', False, "", True), (r'\$*("""+)', "{0}", False, "", True), (r'\$"', '"', True, "{", False), *PLAIN), name=r"@?" + NAME, comments=SLASHES + r"|^[ \t]*\#[^\n]*"),
    "rust": Grammar(((r'b?r(#*)"', '"{0}', False, "", True), (r'b?"', '"', True, "", True), (r"b?'(?=\\|[^\\'\n]')", "'", True, "", False)), name=r"r\#" + NAME + "|" + NAME + "|'" + NAME, nested_comments=True),
    "php": Grammar(((r'"', '"', True, "{$", True), (r"'", "'", True, "", True)), comments=r"/\*[\s\S]*?(?:\*/|\Z)|(?://|\#(?!\[))(?:(?!\?>)[^\n])*|\?>[\s\S]*?(?:<\?(?:php|=)?|\Z)", name=r"\$?" + NAME, here=r"<<<[ \t]*(['\"]?)([^\W\d]\w*)\1"),
    "ruby": Grammar(((r'"', '"', True, "#{", True), (r"'", "'", True, "", True), (r"`", "`", True, "#{", True), (r"%[QWIx]?([(\[{<|!])", "{0}", True, "#{", True), (r"%[qwis]([(\[{<|!])", "{0}", True, "", True)),
                    comments=r"^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z)|^__END__$[\s\S]*|\#[^\n]*", name=r"[@$]{0,2}[^\W\d]\w*(?:[?!](?![=~])|[?!](?===))?", regex_after=_BEFORE_REGEX, here=r"<<(?:[~-](['\"`]?)([^\W\d]\w*)\1|(['\"`]?)([A-Z]\w*)\3)"),
}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: First on its line; for strings what they say, computed parts as ``{}``.
    first: bool = False
    said: str = ""


@dataclass
class _Open:
    """A string that is not closed yet."""

    start: int
    inside: int
    stop: re.Pattern
    hole: str
    over_lines: bool
    close: str
    pieces: list[str] = field(default_factory=list)
    level: int = 0
    depth: int = 0


def _nested(text: str, at: int) -> int:
    """End of the comment that opens at ``at``, with comments inside."""
    level = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        level += 1 if m[0] == "/*" else -1
        if not level:
            return m.end()
    return len(text)


def _value(tokens: list[Token], grammar: Grammar) -> bool:
    """Does the last token end a value, so that a slash divides and a percent sign is an operator?"""
    if not tokens:
        return False
    last = tokens[-1]
    return last.kind in (TEXT, NUMBER) or last.text in (")", "]", "}") or (last.kind == WORD and last.text not in (grammar.regex_after or ()))


def _opened(text: str, m: re.Match, form: Form) -> _Open:
    close = form[1].replace("{0}", m[1]) if "{0}" in form[1] else form[1]
    close = _PAIRS.get(close, close)
    bits = [r"\\[\s\S]"] if form[2] else [re.escape(close * 2)] if m[0].startswith(("@", "$@")) else []
    bits += [r"\{\{"] if form[3] == "{" else []
    bits += [re.escape(form[3])] if form[3] else []
    bits += [re.escape(m[1])] if "{0}" in form[1] and close != m[1] and m[0][0] == "%" else []
    return _Open(m.start(), m.end(), re.compile("|".join([*bits, re.escape(close), r"\n"])), form[3], form[4], close, [], 0)


def tokens_of(text: str, language: str) -> list[Token]:
    """Tokens in order. A quote that is not closed where it must be is a mark of its own."""
    g = GRAMMARS[language]
    forms = [(re.compile(f[0]), f) for f in g.forms]
    space, comment, name, number, mark = re.compile(r"[ \t\r\f\v\u00a0\ufeff]+"), re.compile(g.comments, re.MULTILINE), re.compile(g.name), re.compile(r"\d[\w.]*"), re.compile(MARKS, re.DOTALL)
    regex = re.compile(r"/(?![*/=\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
    here = re.compile(g.here) if g.here else None
    out: list[Token] = []
    strings: list[_Open] = []
    waiting: list[str] = []
    i, fresh, plain_at = 0, True, -1
    if language == "php":
        start = re.search(r"<\?(?:php|=)?", text)
        i = start.end() if start else len(text)

    def give(kind: str, end: int, said: str = "") -> None:
        nonlocal fresh
        if not strings:
            out.append(Token(kind, text[i:end], i, end, fresh, said))
            fresh = False

    while i < len(text):
        if strings and strings[-1].depth == 0:
            s = strings[-1]
            m = s.stop.search(text, s.inside if i < s.inside else i)
            if m is None or (m[0] == "\n" and not s.over_lines):  # not closed: its quote stands for itself
                strings.pop()
                i = plain_at = s.start
                continue
            s.pieces.append(text[max(i, s.inside) : m.start()])
            i = m.end()
            if m[0] == s.close and not s.level:
                strings.pop()
                end, i = i, s.start
                give(TEXT, end, "".join(s.pieces))
                i = end
            elif m[0] == s.hole:
                s.depth = 1
                s.pieces.append("{}")
            else:
                s.level += {s.close: -1}.get(m[0], 1 if s.close in _PAIRS.values() and _PAIRS.get(m[0]) == s.close else 0)
                s.pieces.append(m[0])
            continue
        c = text[i]
        if c == "\n":
            i, fresh = i + 1, fresh or not strings
            while waiting:
                end = re.compile(rf"^[ \t]*{waiting.pop(0)}\b", re.MULTILINE).search(text, i)
                i = end.end() if end else len(text)
        elif m := space.match(text, i):
            i = m.end()
        elif g.nested_comments and text.startswith("/*", i):
            i = _nested(text, i)
        elif m := comment.match(text, i):
            i = max(m.end(), i + 1)
        elif here and not strings and (m := here.match(text, i)) and (text[i + 2] in "~-<" or not _value(out, g)):
            waiting.append(next(x for x in m.groups()[1::2] if x))
            give(TEXT, m.end())
            i = m.end()
        elif i != plain_at and (found := next(((m, f) for p, f in forms if (m := p.match(text, i))), None)) and not (c == "%" and _value(out, g) and not re.match(r"%[wWiIqQ]", text[i:])):
            strings.append(_opened(text, *found))
            i = found[0].end()
        elif language == "ruby" and not strings and c == ":" and text[i + 1 : i + 2] != ":" and (m := re.compile(r":(?:\"[^\"\n]*\"|[^\W\d]\w*[?!=]?|[+\-*/<>=!\[\]]+)").match(text, i)) and not (out and out[-1].end == i and out[-1].kind == WORD):
            give(TEXT, m.end(), m[0][1:])
            i = m.end()
        elif c == "/" and g.regex_after is not None and (m := regex.match(text, i)) and (not _value(out, g) or (language == "ruby" and out[-1].kind == WORD and out[-1].end < i)) and not (out and out[-1].text == "<"):
            give(TEXT, m.end())
            i = m.end()
        elif m := name.match(text, i):
            end = m.end()
            label = language == "ruby" and text[end : end + 1] == ":" and text[end + 1 : end + 2] != ":" and text[i - 1] != "?"
            give(TEXT if label else WORD, end, m[0])
            i = end
        elif m := number.match(text, i):
            give(NUMBER, m.end())
            i = m.end()
        else:
            m = mark.match(text, i)
            if strings:
                strings[-1].depth += {"{": 1, "}": -1}.get(m[0], 0)
            give(MARK, m.end())
            i = m.end()
        if i >= len(text) and strings:  # the end of the text inside a string
            i = plain_at = strings[0].start
            strings.clear()
    return out


def blanked(text: str, language: str) -> str:
    """The text with everything between its tokens as spaces: comments and the bodies of here documents; lines stay."""
    out, at = [], 0
    for t in [*tokens_of(text, language), Token(MARK, "", len(text), len(text))]:
        out += [re.sub(r"[^\n]", " ", text[at : t.start]), text[t.start : t.end]]
        at = t.end
    return "".join(out)


class Code:
    """Tokens with their brackets: ``match`` leads both ways, ``around`` to the brace that a token stands in (or -1)."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.tokens = text, language, tokens_of(text, language)
        self.match: dict[int, int] = {}
        self.around: list[int] = []
        stack: list[int] = []
        braces = [-1]
        for i, t in enumerate(self.tokens):
            if t.kind == MARK and t.text in ")]}":
                opening = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 50), -1) if _PAIRS[self.tokens[stack[k]].text] == t.text), None)
                if opening is not None:
                    begin = stack[opening]
                    self.match[begin], self.match[i] = i, begin
                    del stack[opening:]
                    while braces[-1] >= begin:
                        braces.pop()
            self.around.append(braces[-1])
            if t.kind == MARK and t.text in "([{":
                stack.append(i)
                if t.text == "{":
                    braces.append(i)

    def at(self, i: int) -> str:
        """The token's text; strings and what is outside say nothing."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind != TEXT else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == WORD

    def first(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].first

    def skip(self, i: int) -> int:
        """Behind the token, or behind the bracket that it opens."""
        return self.match[i] + 1 if i in self.match and self.match[i] > i else i + 1

    def generics(self, i: int) -> int:
        """Behind the type arguments at ``i``; ``i`` if there are none."""
        if self.at(i) != "<":
            return i
        level, j = 0, i
        while j < len(self.tokens) and j < i + 400:
            x = self.at(j)
            level += (x == "<") - (x == ">")
            if not level:
                return j + 1
            if x in (";", ")", "]", "}"):
                return i
            j = self.skip(j)
        return i

    def slice(self, start: int, end: int) -> str:
        """Source from token ``start`` up to token ``end``, without it."""
        return self.text[self.tokens[start].start : self.tokens[end - 1].end] if start < end else ""

    def arguments(self, opening: int) -> list[tuple[int, int]]:
        """Token ranges between a bracket's commas."""
        out, start, j, close = [], opening + 1, opening + 1, self.match.get(opening, len(self.tokens))
        while j < close:
            if self.at(j) == ",":
                out.append((start, j))
                start = j + 1
            j = self.skip(j)
        return [*out, (start, close)] if start < close else out
