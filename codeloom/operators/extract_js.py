"""Symbols, imports and calls of one JavaScript or TypeScript file.

No JavaScript parser ships with Python, so this reads the file in three steps: tokens (strings, templates, regular
expressions and JSX told apart by what came before), brackets matched to each other and the whole held against the grammar
(``grammar_js``), and statements recognised by how they begin. ``parse_ok`` means that the file follows the grammar.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from codeloom.operators.grammar_js import Broken, Grammar

Symbols = list[tuple[str, str, int, int, str | None]]
Imports = list[tuple[str, int, int, str | None, str | None, bool]]
Calls = list[tuple[str, int, str | None, bool]]

# Fixed values of the language.
_KEYWORDS = set(
    "await break case catch class const continue debugger default delete do else enum export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with yield null true false".split()
)
#: After these words an expression begins, so a slash starts a regular expression.
_OPENS = set("await case delete do else extends in instanceof new of return throw typeof void yield default".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_TYPE_PARAMETERS = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|\s+extends\b)")
_PUNCT = re.compile(r">>>=|\*\*=|<<=|>>=|===|!==|>>>|\.\.\.|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_NAME = re.compile(r"(?:[^\W\d]|[$]|\\u\{?[0-9a-fA-F]+\}?)(?:\w|[$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_BLANK = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|﻿)+", re.S)
#: What a stretch that _BLANK matches may begin with, the end of the text included, and punctuation that no longer one begins with.
_BEGIN_BLANK = {"", "/", "\ufeff", *(chr(k) for k in range(0x3001) if chr(k).isspace())}
_SINGLE = set("{}[];,:~@")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
#: The most frequent tokens, with the blanks before them: a name of ASCII letters, a token of one character, a string without escapes, a round bracket; or line ends.
_PLAIN = re.compile(r"[ \t]*+(?:([A-Za-z_$][A-Za-z0-9_$]*+)(?![\\\u0080-\U0010ffff])|([{}\[\];,:~@])|('[^'\\\n]*+'|\"[^\"\\\n]*+\")|(\n[ \t\n\r]*+)|([()]))")

_WORDS = {"punct", "name"}
#: What may come before the word that tells what a statement is, and the words of statements that end in a block or declare a name of the file.
_BEFORE_HEAD = {"@", "export", "default", "declare", "async"}
_BLOCK_BEGINS = set("function class if for while do try switch enum with { interface namespace module abstract".split())
_DECLARES = {"function", "class", "interface", "type"}


@dataclass(slots=True)
class Token:
    kind: str  # name, private, punct, string, number, regex, template
    text: str
    line: int
    end_line: int


class Scanner:
    """Tokens of a source. What a template or JSX embeds comes between a ``(`` and a ``)`` of its own."""

    def __init__(self, source: str, jsx: bool):
        self.s, self.at, self.line, self.jsx, self.out = source, 0, 1, jsx, []
        self.heads: list[bool] = []  # of each round bracket that is open, and of the last one closed: whether it is the condition of a statement
        self.head = False
        if source.startswith("#!"):
            self.at = (source + "\n").index("\n")

    def put(self, kind: str, text: str, end: int) -> None:
        if text == "(":
            before = self.out[-2:]
            self.heads.append(bool(before) and before[-1].kind == "name" and before[-1].text in ("if", "while", "for", "with") and before[0].text not in (".", "?."))
        elif text == ")" and self.heads:
            self.head = self.heads.pop()
        lines = self.s.count("\n", self.at, end)
        self.out.append(Token(kind, text, self.line, self.line + lines))
        self.line += lines
        self.at = end

    def skip(self, end: int) -> None:
        self.line += self.s.count("\n", self.at, end)
        self.at = end

    def expects_value(self) -> bool:
        """Whether an expression may begin here."""
        if not self.out:
            return True
        t = self.out[-1]
        if t.kind == "punct":
            return self.head if t.text == ")" else t.text not in ("]", "}", "++", "--")
        return t.kind == "name" and t.text in _OPENS

    def plain(self) -> None:
        """Scan as far as only tokens of ``_PLAIN`` come: one match each."""
        s, at, line, out, match = self.s, self.at, self.line, self.out, _PLAIN.match
        while m := match(s, at):
            kind, at = m.lastindex, m.end()
            if kind == 1:
                out.append(Token("name", m[1], line, line))
            elif kind == 2:
                out.append(Token("punct", m[2], line, line))
            elif kind == 3:
                out.append(Token("string", m[3], line, line))
            elif kind == 4:
                line += m[4].count("\n")
            else:
                self.at, self.line = at - 1, line
                self.put("punct", m[5], at)
        self.at, self.line = at, line

    def run(self, until: str | None = None) -> None:
        """Scan to the end, or to the bracket ``until`` that closes what was open."""
        depth, size = 0, len(self.s)
        while True:
            if until is None:
                self.plain()
            if self.s[self.at : self.at + 1] in _BEGIN_BLANK and (m := _BLANK.match(self.s, self.at)):
                self.skip(m.end())
            if self.at >= size:
                if until:
                    raise Broken
                return
            c = self.s[self.at]
            if until and not depth and c == until:
                return
            if c == "/" and self.s.startswith("/*", self.at):
                raise Broken
            if c in _SINGLE:  # most punctuation: a token of one character on one line
                depth += (c in "[{") - (c in "]}")
                self.out.append(Token("punct", c, self.line, self.line))
                self.at += 1
            elif c in "'\"":
                if not (m := _STRING.match(self.s, self.at)):
                    raise Broken
                self.put("string", m[0], m.end())
            elif c == "`":
                self.template()
            elif m := _NAME.match(self.s, self.at):
                self.out.append(Token("name", m[0], self.line, self.line))  # names have no line ends
                self.at = m.end()
            elif c.isdigit() or (c == "." and self.s[self.at + 1 : self.at + 2].isdigit()):
                m = _NUMBER.match(self.s, self.at)
                self.put("number", m[0], m.end())
            elif c == "#" and (m := _NAME.match(self.s, self.at + 1)):
                self.put("private", "#" + m[0], m.end())
            elif c == "/" and self.expects_value():
                if not (m := _REGEX.match(self.s, self.at)):
                    raise Broken
                self.put("regex", m[0], m.end())
            elif c == "<" and self.jsx and self.expects_value() and re.match(r"<(?:>|[A-Za-z_$])", self.s[self.at : self.at + 2]) and not self.type_parameters():
                self.element()
            elif m := _PUNCT.match(self.s, self.at):
                depth += (c in "([{") - (c in ")]}")
                self.put("punct", m[0], m.end())
            else:
                raise Broken

    def type_parameters(self) -> bool:
        """``<T,>(x)`` or ``<T extends U>(x)``: an arrow function's type parameters, not an element."""
        return bool(_TYPE_PARAMETERS.match(self.s, self.at))

    def embedded(self) -> None:
        """{...} of a template or of JSX: its tokens stand in parentheses."""
        self.put("punct", "(", self.at + 1)
        self.run("}")
        self.put("punct", ")", self.at + 1)

    def template(self) -> None:
        self.put("template", "`", self.at + 1)
        while True:
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(self.s, self.at)
            self.skip(m.end())
            if self.s.startswith("${", self.at):
                self.skip(self.at + 1)
                self.embedded()
            elif self.s.startswith("`", self.at):
                self.skip(self.at + 1)
                self.out.append(Token("template", "`", self.line, self.line))
                return
            else:
                raise Broken

    def element(self) -> None:
        """A JSX element: one value; only what its braces embed leaves tokens."""
        self.put("template", "<", self.at + 1)
        open_ = 0
        while True:
            # inside a tag, from after "<" to ">"
            closing = self.s.startswith("/", self.at)
            if closing:
                self.skip(self.at + 1)
            alone = False
            while True:
                if m := _BLANK.match(self.s, self.at):
                    self.skip(m.end())
                if self.at >= len(self.s):
                    raise Broken
                c = self.s[self.at]
                if c == "{":
                    self.embedded()
                elif c in "'\"":
                    end = self.s.find(c, self.at + 1)
                    if end < 0:
                        raise Broken
                    self.skip(end + 1)
                elif c == "/":
                    alone = True
                    self.skip(self.at + 1)
                elif c == ">":
                    self.skip(self.at + 1)
                    break
                elif m := re.compile(r"[\w$.:=-]+").match(self.s, self.at):
                    self.skip(m.end())
                else:
                    raise Broken
            open_ += -1 if closing else 0 if alone else 1
            if open_ <= 0:
                self.out.append(Token("template", ">", self.line, self.line))
                return
            # children, up to the next tag
            while not self.s.startswith("<", self.at):
                if self.at >= len(self.s):
                    raise Broken
                if self.s[self.at] == "{":
                    self.embedded()
                else:
                    m = re.compile(r"[^<{]+").match(self.s, self.at)
                    self.skip(m.end())
            self.skip(self.at + 1)


class Source:
    """A file's tokens with matched brackets and its statements."""

    def __init__(self, text: str, suffix: str):
        self.ts = suffix in (".ts", ".tsx")
        scan = Scanner(text, jsx=suffix != ".ts")
        scan.run()
        self.t = scan.out
        self.n, self.words = len(self.t), [t.text if t.kind in _WORDS else None for t in self.t]  # what is_ compares
        self.match: dict[int, int] = {}
        self.around = [-1] * len(self.t)  # the bracket that each token stands in
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "punct" and t.text in (")", "]", "}"):
                if not stack or _CLOSE[self.t[stack[-1]].text] != t.text:
                    raise Broken
                self.match[i], self.match[stack[-1]] = stack[-1], i
                stack.pop()
            self.around[i] = stack[-1] if stack else -1
            if t.kind == "punct" and t.text in _CLOSE:
                stack.append(i)
        if stack:
            raise Broken
        self.next = list(range(1, self.n + 1))  # the next token on the same level
        for i, end in self.match.items():
            if i < end:
                self.next[i] = end + 1
        Grammar(self.t, self.match, self.ts).file()
        self.outer = self.statements(0, len(self.t))

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.words[i] in texts

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and self.t[i].text not in _KEYWORDS

    def after(self, i: int) -> int:
        """The next token on the same level."""
        return self.next[i] if 0 <= i < self.n else i + 1

    def continues(self, i: int) -> bool:
        """Whether token i, at the start of a line, goes on with the expression before it."""
        prev, t = self.t[i - 1], self.t[i]
        if prev.kind == "punct" and prev.text not in (")", "]", "}", "++", "--"):
            return True
        if prev.kind == "name" and prev.text in _OPENS | {"const", "let", "var", "function", "class", "extends", "async", "import", "export", "from", "as"}:
            return True
        if t.kind == "punct":
            return t.text not in ("{", "}", "++", "--", "@", "!", "~", "#", ";")
        return t.kind == "name" and t.text in ("in", "instanceof", "as", "satisfies", "of", "from", "extends", "implements", "else", "catch", "finally", "while") or (t.kind == "template" and t.text == "`")

    def statements(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """(first, end) of the statements between two tokens of one level."""
        out, i = [], lo
        while i < hi:
            if self.is_(i, ";"):
                i += 1
                continue
            start, block = i, self.ends_in_block(i)
            while i < hi:
                here = i
                i = self.after(i)
                if self.is_(here, ";") or (block and self.is_(here, "{") and not self.block_goes_on(here, i, hi)):
                    break
                if i < hi and self.t[i].line > self.t[i - 1].end_line and not self.continues(i) and not (block and self.header_open(start, i)):
                    break
            out.append((start, i))
        return out

    def head(self, i: int) -> int:
        """The token that tells what a statement is: past export, default, declare, decorators and async."""
        while True:
            if not 0 <= i < self.n or self.words[i] not in _BEFORE_HEAD:
                return i
            if self.is_(i, "@"):
                i += 2
                while self.is_(i, "."):
                    i += 2
                if self.is_(i, "("):
                    i = self.after(i)
            elif self.is_(i, "export", "default", "declare") or (self.is_(i, "async") and self.is_(i + 1, "function")):
                i += 1
            else:
                return i

    def ends_in_block(self, i: int) -> bool:
        h = self.head(i)
        if h >= self.n or self.words[h] not in _BLOCK_BEGINS:
            return False
        return self.is_(h, "function", "class", "if", "for", "while", "do", "try", "switch", "enum", "with") or (h == i and self.is_(h, "{")) or (
            self.is_(h, "interface", "namespace", "module", "abstract") and self.name(h + 1) or self.is_(h, "abstract") and self.is_(h + 1, "class")
        )

    def header_open(self, start: int, i: int) -> bool:
        """A function, class or loop whose body has not come yet."""
        return not any(self.is_(k, "{") and self.around[k] == self.around[start] for k in range(start, i)) and self.is_(self.head(start), "function", "class", "interface")

    def block_goes_on(self, brace: int, i: int, hi: int) -> bool:
        return i < hi and self.is_(i, "else", "catch", "finally") or (i < hi and self.is_(i, "while") and self.is_(brace - 1, "do"))

    # ---- what is extracted

    def declarations(self) -> list[tuple[str, int, int, int]]:
        """(kind, name token, first, end) of the outer functions, classes, interfaces and type aliases."""
        out = []
        for first, end in self.outer:
            h = self.head(first)
            if h >= self.n or self.words[h] not in _DECLARES:
                continue
            exported = self.is_(first, "export")
            begin = h - 1 if self.is_(h - 1, "async") and h > first else h
            if exported and self.is_(first + 1, "default") and self.is_(h, "function", "class") and not self.name(h + 1):
                continue
            if self.is_(h, "function") and self.name(h + 1):
                if not self.is_(h + 2, "(", "<"):
                    raise Broken
                if any(self.is_(k, "{") and self.around[k] == self.around[h] for k in range(h, end)):
                    out.append(("function", h + 1, begin, end))
            elif self.is_(h, "class") and self.name(h + 1):
                out.append(("class", h + 1, h, end))
            elif self.ts and self.is_(h, "interface") and self.name(h + 1):
                out.append(("interface", h + 1, h, end))
            elif self.ts and self.is_(h, "type") and self.name(h + 1) and self.is_(h + 2, "=", "<"):
                out.append(("type_alias", h + 1, h, end))
        return out

    def lines(self, first: int, end: int) -> tuple[int, int]:
        return self.t[first].line, self.t[end - 1].end_line

    def body(self, first: int, end: int) -> int:
        """The brace that opens a class's body: the last one on its level."""
        found = [k for k in range(first, end) if self.is_(k, "{") and self.around[k] == self.around[first]]
        if not found:
            raise Broken
        return found[-1]

    def methods(self, brace: int) -> list[tuple[int, int, int]]:
        """(name token, first, end) of the methods with a body between the braces of a class."""
        out, i, stop = [], brace + 1, self.match[brace]
        first = i
        while i < stop:
            if self.is_(i, ";"):
                i += 1
                first = i
                continue
            if self.is_(i, "@"):
                first = i = self.head(i)
                continue
            if self.is_(i, "=", ":"):  # a field: up to its end
                while i < stop and not self.is_(i, ";"):
                    i = self.after(i)
                    if i < stop and self.t[i].line > self.t[i - 1].end_line and not self.continues(i):
                        break
                first = i
                continue
            at = i + 1
            if self.is_(at, "<"):
                at = self.past_angles(at)
            if self.t[i].kind in ("name", "private", "string", "number") or self.is_(i, "]"):
                if self.is_(at, "("):
                    end = at = self.match[at] + 1
                    if self.is_(at, ":"):  # a return type
                        at += 1
                        while at < stop and not self.is_(at, ";") and not (self.is_(at, "{") and not self.is_(at - 1, ":", "|", "&", "<", ",", "=>")):
                            at = self.after(at)
                    if self.is_(at, "{"):
                        end = self.match[at] + 1
                        if self.t[i].kind == "name":
                            out.append((i, first, end))
                    i = first = max(end, at)
                    continue
            i = self.after(i)
            if i < stop and self.t[i].line > self.t[i - 1].end_line and self.t[i - 1].kind == "name" and self.t[i - 1].text not in ("static", "get", "set", "async", "public", "private", "protected", "readonly", "override", "abstract"):
                first = i
        return out

    def past_angles(self, i: int) -> int:
        """Past <...> of types, or i itself if this is a comparison: what ends the statement or closes a bracket around it comes first."""
        depth, k = 0, i
        while k < len(self.t):
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">", ">>", ">>>"):
                depth -= len(self.text(k))
                if depth <= 0:
                    return k + 1
            elif self.t[k].kind == "punct" and self.text(k) in (";", "&&", "||", "+", "-", "==", ")", "]", "}"):
                return i
            k = self.after(k)
        return i

    def class_bodies(self) -> list[int]:
        out = []
        for i, t in enumerate(self.t):
            if t.kind == "name" and t.text == "class" and not self.is_(i - 1, "."):
                k = i + 1
                while k < len(self.t) and not self.is_(k, "{", ";", ")", "]", "}"):
                    k = self.after(k)
                if self.is_(k, "{"):
                    out.append(k)
        return out

    def extract(self) -> tuple[Symbols, Imports, Calls]:
        declared = self.declarations()
        symbols: Symbols = [(self.text(n), kind, *self.lines(a, b), None) for kind, n, a, b in declared if kind in ("function", "class")]
        symbols.sort(key=lambda s: s[1] != "function")  # functions first; stable
        for first, end in self.outer:
            h = self.head(first)
            if self.is_(h, "const", "let", "var") and not self.is_(h + 1, "enum"):
                symbols += [(self.text(n), "variable", *self.lines(h, end), None) for n in self.declarators(h, end)]
        for kind, n, a, b in declared:
            if kind == "class":
                symbols += [(self.text(m), "method", *self.lines(x, y), self.text(n)) for m, x, y in self.methods(self.body(a, b))]
        for wanted in ("interface", "type_alias"):
            symbols += [(self.text(n), kind, *self.lines(a, b), None) for kind, n, a, b in declared if kind == wanted]
        return symbols, self.imports(), self.calls(declared)

    def declarators(self, h: int, end: int) -> list[int]:
        """Name tokens of the declarators of const, let or var that bind a plain name."""
        out, i, fresh = [], h + 1, True
        while i < end:
            if fresh and self.name(i):
                out.append(i)
            fresh = self.is_(i, ",")
            i = self.after(i)
        return out

    @staticmethod
    def value(token: Token) -> str:
        return token.text[1:-1]

    def imports(self) -> Imports:
        taken: Imports = []
        again: Imports = []
        for first, end in self.outer:
            line = self.t[first].line
            if self.is_(first, "import") and not self.is_(first + 1, "(", "."):
                strings = [k for k in range(first, end) if self.t[k].kind == "string" and self.around[k] == self.around[first]]
                if not strings or not self.value(self.t[strings[0]]) or not (strings[0] == first + 1 or self.is_(strings[0] - 1, "from")):
                    continue
                module = self.value(self.t[strings[0]])
                brace = next((k for k in range(first, strings[0]) if self.is_(k, "{")), None)
                names = self.specifiers(brace) if brace is not None else []
                taken += [(module, 0, line, local, name, False) for local, name in names] or [(module, 0, line, None, None, False)]
            elif self.is_(first, "export"):
                from_ = next((k for k in range(first, end) if self.is_(k, "from") and self.around[k] == self.around[first] and k + 1 < end and self.t[k + 1].kind == "string"), None)
                if from_ is not None and self.is_(first + 1, "{", "*", "type") and self.value(self.t[from_ + 1]):
                    again.append((self.value(self.t[from_ + 1]), 0, line, None, None, False))
        return taken + again + self.requires()

    def specifiers(self, brace: int) -> list[tuple[str, str]]:
        """(local, imported) of {a, b as c, type d}."""
        out, part = [], []
        for k in range(brace + 1, self.match[brace] + 1):
            if k == self.match[brace] or self.is_(k, ","):
                words = [self.text(p) for p in part]
                if len(words) in (2, 4) and words[0] == "type" and words[1] != "as":
                    words = words[1:]
                if len(words) == 3 and words[1] == "as":
                    out.append((words[2], words[0]))
                elif len(words) == 1:
                    out.append((words[0], words[0]))
                part = []
            else:
                part.append(k)
        return out

    def requires(self) -> Imports:
        out: Imports = []
        for i, t in enumerate(self.t):
            if not (t.kind == "name" and t.text == "require" and self.is_(i + 1, "(") and not self.is_(i - 1, ".", "?.", "function", "new")):
                continue
            modules = [self.value(self.t[k]) for k in range(i + 2, self.match[i + 1]) if self.t[k].kind == "string" and self.around[k] == i + 1 and self.is_(k - 1, "(", ",") and self.is_(k + 1, ")", ",")]
            if not any(modules) or not self.runs_at_load(i):
                continue
            names: list[tuple[str, str]] = []
            if self.is_(i - 1, "=") and self.is_(i - 2, "}") and self.is_(self.match[i - 2] - 1, "const", "let", "var", ","):
                names = self.pattern(self.match[i - 2])
            for module in filter(None, modules):
                out += [(module, 0, t.line, local, name, False) for local, name in names] or [(module, 0, t.line, None, None, False)]
        return out

    def pattern(self, brace: int) -> list[tuple[str, str]]:
        """(local, imported) of the plain members of {a, b: c}."""
        out, k, stop = [], brace + 1, self.match[brace]
        while k < stop:
            end = k
            while end < stop and not self.is_(end, ","):
                end = self.after(end)
            if end == k + 1 and self.name(k):
                out.append((self.text(k), self.text(k)))
            elif end == k + 3 and self.is_(k + 1, ":") and self.name(k + 2):
                out.append((self.text(k + 2), self.text(k)))
            k = end + 1
        return out

    def runs_at_load(self, i: int) -> bool:
        """Whether the nearest declaration or expression statement around token i stands directly in the file."""
        while True:
            level = self.around[i]
            if level >= 0 and not self.is_block(level):
                i = level
                continue
            lo, hi = (level + 1, self.match[level]) if level >= 0 else (0, len(self.t))
            first = next((a for a, b in (self.outer if level < 0 else self.statements(lo, hi)) if a <= i < b), i)
            plain = self.is_(first, "const", "let", "var") or not self.is_(
                first, "return", "if", "for", "while", "do", "switch", "try", "throw", "function", "class", "export", "import", "break", "case", "default", "async", "{", "interface", "enum"
            )
            if plain:
                return level < 0
            if level < 0:
                return False
            i = level

    def is_block(self, brace: int) -> bool:
        """A brace that holds statements, not members of an object."""
        return self.text(brace) == "{" and (brace == 0 or self.is_(brace - 1, ")", "=>", ";", "{", "}", "else", "try", "do", "finally") or self.name(brace - 1))

    def calls(self, declared: list[tuple[str, int, int, int]]) -> Calls:
        # top-level ranges lie one behind the other, so the last that begins before a token is the only one that may hold it
        owners = sorted((a, b, self.text(n)) for kind, n, a, b in declared if kind in ("function", "class"))
        bodies = set(self.class_bodies())
        defined = {m for brace in bodies for m, _, _ in self.methods(brace)}
        typed = sorted((a, b) for kind, _, a, b in declared if kind in ("interface", "type_alias"))
        owner_at, typed_at = [o[0] for o in owners], [t[0] for t in typed]
        modifiers = ("{", "}", ";", "static", "get", "set", "async", "public", "private", "protected", "readonly", "override", "abstract")

        def owner(i: int) -> str | None:
            k = bisect.bisect_right(owner_at, i) - 1
            return owners[k][2] if k >= 0 and i < owners[k][1] else None

        def in_type(i: int) -> bool:
            k = bisect.bisect_right(typed_at, i) - 1
            return k >= 0 and i < typed[k][1]

        plain: Calls = []
        own: Calls = []
        begins = {"(", "?.", "<"} if self.ts else {"(", "?."}
        for i, t in enumerate(self.t):
            if t.kind != "name" or i + 1 >= self.n or (self.words[i + 1] not in begins and self.t[i + 1].kind != "template"):
                continue  # most names: nothing that a call goes on with
            if i in defined or in_type(i) or (self.around[i] in bodies and self.is_(i - 1, *modifiers)):
                continue  # members and types, not calls
            at = i + 1
            if self.is_(at, "?.") and self.is_(at + 1, "("):
                at += 1
            if self.ts and self.is_(at, "<"):
                at = self.past_angles(at)
            tagged = at < len(self.t) and self.t[at].kind == "template" and self.t[at].text == "`" and self.t[at].line == t.end_line
            if not tagged:
                if not self.is_(at, "("):
                    continue
                follow = self.match[at] + 1
                if self.is_(follow, "=>") or (self.is_(follow, "{") and self.t[follow].line == self.t[follow - 1].line and not self.is_(i - 1, "await", "=", "return")):
                    continue
            if self.is_(i - 1, ".", "?."):
                if self.is_(i - 2, "this") and not self.is_(i - 3, ".", "?.") and not tagged:
                    own.append((t.text, self.t[i - 2].line, owner(i), True))
                continue
            if t.text in _KEYWORDS or self.is_(i - 1, "function", "new", "class") or (self.is_(i - 1, "*") and self.is_(i - 2, "function")):
                continue
            plain.append((t.text, t.line, owner(i), False))
        return plain + own


def extract(text: str, suffix: str) -> tuple[bool, Symbols, Imports, Calls]:
    """(parse_ok, symbols, imports, calls); nothing is extracted from a file that does not parse."""
    try:
        return True, *Source(text, suffix).extract()
    except (Broken, RecursionError, KeyError, IndexError):
        return False, [], [], []
