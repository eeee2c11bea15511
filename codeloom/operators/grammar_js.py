"""Whether the tokens of a JavaScript or TypeScript file follow the grammar: recursive descent, nothing is built.

Expressions are lists of operands between operators, since how tightly an operator binds decides no file's correctness. Patterns and
arrow functions are read as expressions first where only a later token tells (the cover grammar); TypeScript's type
arguments are tried and taken back if what follows rules them out.
"""

from __future__ import annotations

import sys

# Fixed values of the languages.
RESERVED = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with".split()
)
_UNARY = set("! ~ + - ++ -- typeof void delete".split())
_BINARY = set("== != === !== < > <= >= << >> >>> + - * / % & | ^ && || ?? ** instanceof in".split())
_ASSIGN = set("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = set("static public private protected readonly override abstract declare accessor async get set".split())
_TARGETS = {"name", "member", "pattern", "default"}
#: Frames that nesting may take; text nested deeper counts as not parsed.
_DEPTH = 12_000


class Broken(Exception):
    """The file does not parse."""


class Grammar:
    """A cursor over tokens with matched brackets (``match``: index of the partner). ``file`` raises Broken unless all of them parse."""

    def __init__(self, tokens: list, match: dict[int, int], ts: bool):
        self.t, self.match, self.ts, self.n = tokens, match, ts, len(tokens)
        self.words = [t.text if t.kind == "punct" or t.kind == "name" else "" for t in tokens]
        self.i = self.cut = 0  # cut: how many characters of a >> are used
        self.covers: list[int] = []  # {a = 1} seen where only a pattern allows it
        self.no_in = False
        self.bare = False  # behind a type's extends, where infer T extends U is whole
        self.alternative = False  # between ? and :, where (a) : b => c is no arrow function with a type

    # ---- tokens

    def text(self, k: int = 0) -> str:
        """The token k further on, if it is a name or punctuation; "" else."""
        i = self.i + k
        if i >= self.n:
            return ""
        return self.words[i][self.cut :] if self.cut and not k else self.words[i]

    def kind(self, k: int = 0) -> str:
        i = self.i + k
        return self.t[i].kind if i < self.n else ""

    # these are asked for every token, so they look at the words themselves, as text() does
    def at(self, *texts: str) -> bool:
        if self.cut or self.i >= self.n:
            return self.text() in texts
        return self.words[self.i] in texts

    def take(self, *texts: str) -> bool:
        if self.cut or self.i >= self.n:
            if self.text() not in texts:
                return False
        elif self.words[self.i] not in texts:
            return False
        self.i, self.cut = self.i + 1, 0
        return True

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise Broken

    def need_kind(self, *kinds: str) -> None:
        if self.kind() not in kinds:
            raise Broken
        self.i += 1

    def fresh_line(self, k: int = 0) -> bool:
        """Whether a line ends before the token k further on."""
        i = self.i + k
        return i >= self.n or i == 0 or self.t[i].line > self.t[i - 1].end_line

    def is_name(self, k: int = 0) -> bool:
        i = self.i + k
        return i < self.n and self.t[i].kind == "name" and (self.text(k) if self.cut else self.words[i]) not in RESERVED

    def name(self) -> None:
        if not self.is_name():
            raise Broken
        self.i += 1

    def property_name(self) -> None:
        """Any word, private name, string, number or [expression]."""
        if self.take("["):
            self.expression_in()
            self.need("]")
        else:
            self.need_kind("name", "private", "string", "number")

    def end(self) -> None:
        """The end of a statement: a semicolon, or where one is put in."""
        if not self.take(";") and not self.at("}") and not self.fresh_line():
            raise Broken

    def closing(self) -> int:
        """The token that closes the bracket here."""
        return self.match[self.i]

    def tried(self, rule, *args) -> bool:
        """Whether ``rule`` holds here; the cursor stays if it does not."""
        saved = self.i, self.cut, len(self.covers), self.no_in, self.alternative, self.bare
        try:
            if rule(*args) is not False:
                return True
        except Broken:
            pass
        self.i, self.cut, covers, self.no_in, self.alternative, self.bare = saved
        del self.covers[covers:]
        return False

    def list_until(self, close: str, item) -> None:
        """Items parted by commas, the last of which may be left over, and the closing bracket."""
        while not self.take(close):
            item()
            if not self.at(close):
                self.need(",")

    # ---- statements

    def file(self) -> None:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, _DEPTH))
        try:
            while self.i < self.n:
                self.statement()
        finally:
            sys.setrecursionlimit(before)
        if self.covers:
            raise Broken

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def statement(self) -> None:
        t = self.text()
        if t == ";":
            self.i += 1
        elif t == "{":
            self.block()
        elif t in _STATEMENTS and not (t == "import" and self.text(1) in ("(", ".")):
            _STATEMENTS[t](self)
        elif t == "@":
            self.decorators()
            self.statement()
        elif self.is_name() and self.text(1) == ":":
            self.i += 2
            self.statement()
        elif t == "let" and (self.is_name(1) or self.text(1) in ("[", "{")):
            self.variables()
        elif t == "async" and self.text(1) == "function" and not self.fresh_line(1):
            self.i += 1
            self.function_statement()
        elif t in ("using", "await") and self.tried(self.using):
            pass
        elif self.ts and self.is_name() and self.tried(self.ts_statement):
            pass
        else:
            self.expression()
            self.end()

    def using(self) -> bool | None:
        self.take("await")
        if not self.take("using") or self.fresh_line() or self.at("in", "of") or not self.is_name():
            return False
        self.declarators(False)
        self.end()

    def variables(self) -> None:
        self.i += 1
        if self.ts and self.t[self.i - 1].text == "const" and self.at("enum"):
            return self.enum()
        self.declarators(False)
        self.end()

    def declarators(self, in_for: bool) -> None:
        while True:
            self.binding()
            if self.ts and self.take("!"):
                pass
            if self.ts and self.take(":"):
                self.type()
            if self.take("="):
                saved, self.no_in = self.no_in, in_for
                self.assignment()
                self.no_in = saved
            if not self.take(","):
                return

    def binding(self) -> None:
        """A name or a pattern that declares names."""
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.expression_of(self.assignment)
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            self.list_until("}", self.bound_property)
        else:
            self.name()

    def bound_property(self) -> None:
        if self.take("..."):
            return self.binding()
        plain = self.is_name()
        self.property_name()
        if self.take(":"):
            self.binding()
        elif not plain:
            raise Broken
        if self.take("="):
            self.expression_of(self.assignment)

    def condition(self) -> None:
        self.need("(")
        self.expression_in()
        self.need(")")

    def if_(self) -> None:
        while True:
            self.i += 1
            self.condition()
            self.statement()
            if not self.take("else"):
                return
            if not self.at("if"):
                return self.statement()

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def for_(self) -> None:
        self.i += 1
        wait = self.take("await")
        self.need("(")
        if not self.tried(self.for_each):
            if wait:
                raise Broken
            if self.at("var", "const") or self.at("let") and (self.is_name(1) or self.text(1) in ("[", "{")):
                self.i += 1
                self.declarators(True)
            elif not self.at(";"):
                self.no_in = True
                self.expression()
                self.no_in = False
            self.need(";")
            if not self.at(";"):
                self.expression_in()
            self.need(";")
            if not self.at(")"):
                self.expression_in()
        self.need(")")
        self.statement()

    def for_each(self) -> bool | None:
        if self.at("var", "const", "let", "using") or self.at("await") and self.text(1) == "using":
            self.take("await")
            self.i += 1
            self.binding()
            if self.at("="):  # an old form
                self.i += 1
                self.no_in = True
                self.assignment()
                self.no_in = False
        else:
            covers = len(self.covers)
            self.no_in = True
            kind = self.left_hand()
            self.no_in = False
            if kind not in ("name", "member", "pattern", "paren"):
                return False
            del self.covers[covers:]
        if not self.take("in", "of"):
            return False
        self.expression_in()
        return self.at(")")

    def jump(self) -> None:
        word = self.text()
        self.i += 1
        if word in ("break", "continue"):
            if self.is_name() and not self.fresh_line():
                self.i += 1
        elif word == "throw" or not (self.at(";", "}") or self.fresh_line()):
            self.expression()
        self.end()

    def debugger(self) -> None:
        self.i += 1
        self.end()

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression_in()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            raise Broken

    def function_statement(self) -> None:
        self.i += 1
        self.take("*")
        self.name()
        self.signature()
        self.body_or_end()

    def body_or_end(self) -> None:
        if self.ts and not self.at("{"):
            self.end()
        else:
            self.body()

    def body(self) -> None:
        saved = self.no_in, self.alternative
        self.no_in = self.alternative = False
        self.block()
        self.no_in, self.alternative = saved

    def signature(self) -> None:
        """Type parameters, parameters and what is returned."""
        if self.ts and self.at("<"):
            self.type_parameters()
        self.need("(")
        saved = self.no_in, self.alternative
        self.no_in = self.alternative = False
        self.list_until(")", self.parameter)
        self.no_in, self.alternative = saved
        if self.ts and self.take(":"):
            self.type()

    def parameter(self) -> None:
        self.decorators()
        if self.take("..."):
            self.binding()
            if self.ts and self.take(":"):
                self.type()
            return
        if self.ts:
            while self.at("public", "private", "protected", "readonly", "override") and (self.is_name(1) or self.text(1) in ("{", "[")):
                self.i += 1
            if not self.take("this"):
                self.binding()
            self.take("?")
            if self.take(":"):
                self.type()
        else:
            self.binding()
        if self.take("="):
            self.assignment()

    def decorators(self) -> None:
        while self.take("@"):
            if self.at("("):
                self.condition()
            else:
                self.need_kind("name")
                while self.take("."):
                    self.need_kind("name", "private")
                if self.ts and self.at("<"):
                    self.tried(self.type_arguments)
                if self.at("("):
                    self.arguments()

    # ---- classes

    def class_statement(self) -> None:
        self.i += 1
        self.name()
        self.class_tail()

    def class_tail(self) -> None:
        if self.ts and self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.left_hand()
            if self.ts and self.at("<"):
                self.type_arguments()
        if self.ts and self.take("implements"):
            self.types()
        saved = self.no_in, self.alternative
        self.no_in = self.alternative = False
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                self.member()
        self.no_in, self.alternative = saved

    def member(self) -> None:
        self.decorators()
        if self.at("static") and self.text(1) == "{":
            self.i += 1
            return self.block()
        if self.ts and self.at("{"):
            raise Broken
        getter = False
        words = _MODIFIERS if self.ts else {"static", "async", "get", "set", "accessor"}
        while self.text() in words and (self.kind(1) in ("name", "private", "string", "number") or self.text(1) in ("[", "*", "@")) and not (self.text() in ("async", "get", "set", "accessor", "declare") and self.fresh_line(1)):
            getter = self.at("get", "set")
            self.i += 1
            self.decorators()
        star = self.take("*")
        if self.ts and self.at("[") and self.is_name(1) and self.text(2) == ":":
            self.index_signature()
            return self.end()
        self.property_name()
        if self.ts:
            self.take("?", "!")
        if self.at("(") or self.ts and self.at("<"):
            self.signature()
            return self.body_or_end()
        if getter or star:
            raise Broken
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        self.end()

    # ---- modules

    def import_(self) -> None:
        self.i += 1
        if self.kind() == "string":
            self.i += 1
            return self.from_end()
        if self.ts and self.at("type") and (self.text(1) in ("{", "*") or self.is_name(1) and (self.text(1) != "from" or self.text(2) == "from")):
            self.i += 1
        if self.at("defer", "source") and (self.text(1) == "*" or self.is_name(1) and self.text(1) != "from"):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.ts and self.take("="):
                if self.at("require") and self.text(1) == "(":
                    self.i += 2
                    self.need_kind("string")
                    self.need(")")
                else:
                    self.entity()
                return self.end()
            if not self.take(","):
                return self.from_()
            if not self.at("{", "*"):
                raise Broken
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.need("{")
            self.list_until("}", lambda: self.specifier(True))
        self.from_()

    def from_(self) -> None:
        self.need("from")
        self.need_kind("string")
        self.from_end()

    def from_end(self) -> None:
        if self.at("with", "assert") and self.text(1) == "{":
            self.i += 2
            self.list_until("}", self.attribute)
        self.end()

    def attribute(self) -> None:
        self.need_kind("name", "string")
        self.need(":")
        self.need_kind("string")

    def specifier(self, imported: bool) -> None:
        if self.ts and self.at("type") and (self.kind(1) == "string" or self.kind(1) == "name" and (self.text(1) != "as" or self.text(2) == "as")):
            self.i += 1
        plain = self.is_name() or not imported
        self.need_kind("name", "string")
        if self.take("as"):
            self.name() if imported else self.need_kind("name", "string")
        elif not plain:
            raise Broken

    def export(self) -> None:
        self.i += 1
        if self.take("default"):
            self.decorators()
            if self.at("function") or self.at("async") and self.text(1) == "function" and not self.fresh_line(1):
                self.take("async")
                self.i += 1
                self.take("*")
                if self.is_name():
                    self.i += 1
                self.signature()
                self.body_or_end()
            elif self.at("class") or self.ts and self.at("abstract") and self.text(1) == "class":
                self.take("abstract")
                self.i += 1
                if self.is_name() and not self.at("implements"):
                    self.i += 1
                self.class_tail()
            elif self.ts and self.at("interface") and self.is_name(1):
                self.statement()
            else:
                self.assignment()
                self.end()
            return
        if self.ts and self.take("="):
            self.expression()
            return self.end()
        if self.ts and self.at("as") and self.text(1) == "namespace":
            self.i += 2
            self.name()
            return self.end()
        if self.ts and self.at("type") and self.text(1) in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.need_kind("name", "string")
            return self.from_()
        if self.take("{"):
            self.list_until("}", lambda: self.specifier(False))
            return self.from_() if self.at("from") else self.end()
        if self.at("var", "let", "const", "function", "class", "enum", "@", "using") or self.at("async") and self.text(1) == "function" or self.ts and self.at("import"):
            return self.statement()
        if not self.ts or self.ts_statement() is False:
            raise Broken

    # ---- TypeScript's statements

    def ts_statement(self) -> bool | None:
        word = self.text()
        if word == "declare" and not self.fresh_line(1) and self.kind(1) == "name":
            self.i += 1
            if self.take("global"):
                return self.block()
            if self.at("async") or self.text() not in _DECLARED:
                return False
            return self.statement()
        if word == "abstract" and self.text(1) == "class":
            self.i += 1
            return self.class_statement()
        if word == "type" and self.is_name(1) and not self.fresh_line(1):
            self.i += 2
            if self.at("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            return self.end()
        if word == "interface" and self.is_name(1) and not self.fresh_line(1):
            self.i += 2
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.types()
            return self.object_type()
        if word in ("namespace", "module") and (self.is_name(1) or self.kind(1) == "string") and not self.fresh_line(1):
            self.i += 1
            if self.kind() == "string":
                self.i += 1
            else:
                self.entity()
            return self.block() if self.at("{") else self.end()
        if word == "global" and self.text(1) == "{":
            self.i += 1
            return self.block()
        return False

    def enum(self) -> None:
        self.i += 1
        if not self.ts:
            raise Broken
        self.name()
        self.need("{")
        self.list_until("}", self.enum_member)

    def enum_member(self) -> None:
        self.property_name()
        if self.take("="):
            self.assignment()

    # ---- expressions

    def expression_of(self, rule) -> None:
        """Inside brackets: ``in`` is an operator again."""
        saved = self.no_in, self.alternative
        self.no_in = self.alternative = False
        rule()
        self.no_in, self.alternative = saved

    def expression_in(self) -> None:
        self.expression_of(self.expression)

    def expression(self) -> str:
        kind = self.assignment()
        while self.take(","):
            self.assignment()
            kind = "list"
        return kind

    def assignment(self) -> str:
        if self.at("yield"):
            after = self.i + 1 < self.n and not self.fresh_line(1)
            if self.text(1) == "*" and after:
                self.i += 2
                self.assignment()
                return "other"
            if after and self.begins_value(1):
                self.i += 1
                self.assignment()
                return "other"
        if self.arrow():
            return "other"
        covers = len(self.covers)
        kind = self.binary()
        if self.at("?"):
            self.i += 1
            saved, self.alternative, no_in, self.no_in = self.alternative, True, self.no_in, False
            self.assignment()
            self.alternative, self.no_in = saved, no_in
            self.need(":")
            self.assignment()
            return "other"
        if self.at("="):
            if kind not in ("name", "member", "pattern", "paren", "cast"):
                raise Broken
            del self.covers[covers:]
            self.i += 1
            self.assignment()
            return "default" if kind in ("name", "member", "pattern") else "other"
        if self.text() in _ASSIGN or self.cut == 0 and self.at(">>=", ">>>="):
            if kind not in ("name", "member", "paren", "cast"):
                raise Broken
            self.i += 1
            self.assignment()
            return "other"
        return kind

    def begins_value(self, k: int) -> bool:
        kind, t = self.kind(k), self.text(k)
        if kind == "name":
            return t not in RESERVED or t in ("function", "class", "new", "this", "super", "null", "true", "false", "typeof", "void", "delete", "import")
        return kind in ("string", "number", "regex", "private") or kind == "template" and self.t[self.i + k].text in ("`", "<") or t in ("(", "[", "{", "+", "-", "!", "~", "++", "--", "<", "@")

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        k = 1 if self.at("async") and self.text(1) != "=>" and not self.fresh_line(1) else 0
        if self.is_name(k) and self.text(k + 1) == "=>":
            self.i += k + 2
            self.arrow_body()
            return True
        if self.text(k) == "(":
            close = self.match[self.i + k]
            after = self.t[close + 1] if close + 1 < self.n else None
            if after is None or after.kind != "punct":
                return False
            if after.text == "=>" or self.ts and after.text == ":" and self.may_be_parameters(self.i + k):
                return self.tried(self.arrow_function, k, after.text == ":")
            return False
        return self.ts and self.text(k) == "<" and self.tried(self.arrow_function, k, False)

    def may_be_parameters(self, open_: int) -> bool:
        """Whether what a bracket holds begins like parameters."""
        t = self.t[open_ + 1]
        return t.text in (")", "[", "{", "...", "@", "this") or t.kind == "name" and self.t[open_ + 2].text in (",", ")", ":", "?", "=") or t.text in ("public", "private", "protected", "readonly")

    def arrow_function(self, k: int, typed: bool) -> bool | None:
        unsure = typed and self.alternative
        self.i += k
        self.signature()
        self.need("=>")
        self.arrow_body()
        if unsure and not self.at(":"):
            return False

    def arrow_body(self) -> None:
        self.body() if self.at("{") else self.assignment()

    def binary(self) -> str:
        kind = self.unary()
        while True:
            t = self.text()
            if t in _BINARY and not (t == "in" and self.no_in):
                self.i, self.cut = self.i + 1, 0
                self.unary()
                kind = "other"
            elif self.ts and t in ("as", "satisfies") and not self.fresh_line():
                self.i += 1
                if not (t == "as" and self.take("const")):
                    self.type()
                kind = "cast"
            else:
                return kind

    def unary(self) -> str:
        kind = ""
        while True:
            t = self.text()
            if t in _UNARY:
                self.i += 1
            elif t == "await" and self.begins_value(1) and not (self.fresh_line(1) and self.text(1) in ("(", "[", "+", "-")) and self.text(1) != "of":
                self.i += 1
            elif self.ts and t == "<":
                self.type_arguments()
            else:
                break
            kind = "other"
        if self.kind() == "private" and self.text(1) == "in":
            self.i += 1
            return "other"
        found = self.left_hand()
        if self.at("++", "--") and not self.fresh_line():
            self.i += 1
            return "other"
        return kind or found

    def left_hand(self) -> str:
        """An operand with all that is called on or taken out of it."""
        if self.take("new"):
            if self.take("."):
                self.need("target")
                kind = "other"
            else:
                self.new_target()
                kind = "call"
        else:
            kind = self.primary()
        while True:
            t = self.text()
            if t == ".":
                self.i += 1
                self.need_kind("name", "private")
                kind = "member"
            elif t == "?.":
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.at("["):
                    self.subscript()
                elif self.ts and self.at("<"):
                    self.type_arguments()
                    self.arguments()
                else:
                    self.need_kind("name", "private")
                kind = "member"
            elif t == "[":
                self.subscript()
                kind = "member"
            elif t == "(":
                self.arguments()
                kind = "call"
            elif self.kind() == "template" and self.t[self.i].text == "`":
                self.template()
                kind = "call"
            elif self.ts and t == "!" and not self.fresh_line():
                self.i += 1
            elif self.ts and t in ("<", "<<") and self.tried(self.instance):
                kind = "call"
            else:
                return kind

    def instance(self) -> bool | None:
        """Type arguments behind an operand, if what follows cannot go on with a comparison."""
        self.type_arguments()
        if self.at("(") or self.kind() == "template" and self.t[self.i].text == "`":
            return None
        return self.fresh_line() or not self.begins_value(0)

    def new_target(self) -> None:
        if self.at("new") and self.text(1) != ".":
            self.i += 1
            self.new_target()
        elif self.at("new"):
            self.i += 2
            self.need("target")
        elif self.at("import"):
            raise Broken
        else:
            self.primary()
        while True:
            if self.take("."):
                self.need_kind("name", "private")
            elif self.at("["):
                self.subscript()
            elif self.ts and self.at("!") and not self.fresh_line():
                self.i += 1
            elif self.kind() == "template" and self.t[self.i].text == "`":
                self.template()
            else:
                break
        if self.ts and self.at("<"):
            self.tried(self.type_arguments)
        if self.at("("):
            self.arguments()

    def subscript(self) -> None:
        self.need("[")
        self.expression_in()
        self.need("]")

    def arguments(self) -> None:
        self.need("(")
        self.expression_of(lambda: self.list_until(")", self.spread))

    def spread(self) -> str:
        if self.take("..."):
            return "rest" if self.assignment() in _TARGETS else "other"
        return self.assignment()

    def template(self) -> None:
        self.i += 1
        while self.at("("):
            self.condition()
        if self.kind() != "template" or self.t[self.i].text != "`":
            raise Broken
        self.i += 1

    def markup(self) -> None:
        self.i += 1
        while self.at("("):
            self.i += 1
            if not self.at(")"):
                self.take("...")
                self.expression_in()
            self.need(")")
        if self.kind() != "template" or self.t[self.i].text != ">":
            raise Broken
        self.i += 1

    def primary(self) -> str:
        kind, t = self.kind(), self.text()
        if kind in ("string", "number", "regex"):
            self.i += 1
            return "other"
        if kind == "template":
            if self.t[self.i].text not in ("`", "<"):
                raise Broken
            self.template() if self.t[self.i].text == "`" else self.markup()
            return "other"
        if t == "(":
            covers = len(self.covers)
            self.i += 1
            inside = ""

            def body() -> None:
                nonlocal inside
                inside = self.expression()

            self.expression_of(body)
            self.need(")")
            if len(self.covers) > covers:
                raise Broken
            return "paren" if inside in ("name", "member", "paren", "cast") else "other"
        if t == "[":
            return self.array()
        if t == "{":
            return self.object()
        if t == "function" or t == "async" and self.text(1) == "function" and not self.fresh_line(1):
            self.take("async")
            self.i += 1
            self.take("*")
            if self.is_name():
                self.i += 1
            self.signature()
            self.body()
            return "other"
        if t in ("class", "@"):
            self.decorators()
            self.need("class")
            if self.is_name() and not (self.ts and self.at("implements")):
                self.i += 1
            self.class_tail()
            return "other"
        if t == "import":
            self.i += 1
            if self.take("."):
                self.need("meta", "defer", "source")
            elif not self.at("("):
                raise Broken
            return "other"
        if t == "super":
            self.i += 1
            if not self.at(".", "(", "["):
                raise Broken
            return "other"
        if t in ("this", "null", "true", "false"):
            self.i += 1
            return "other"
        self.name()
        return "name"

    def array(self) -> str:
        self.i += 1
        fine = True

        def items() -> None:
            nonlocal fine
            while not self.take("]"):
                if self.take(","):
                    continue
                fine &= self.spread() in _TARGETS | {"rest"}
                if not self.at("]"):
                    self.need(",")

        self.expression_of(items)
        return "pattern" if fine else "other"

    def object(self) -> str:
        self.i += 1
        fine = True

        def member() -> None:
            nonlocal fine
            fine &= self.object_member()

        self.expression_of(lambda: self.list_until("}", member))
        return "pattern" if fine else "other"

    def object_member(self) -> bool:
        """One member of an object; whether it may be a pattern's too."""
        if self.at("..."):
            return self.spread() == "rest"
        accessor = False
        while self.at("async", "get", "set") and (self.kind(1) in ("name", "private", "string", "number") or self.text(1) in ("[", "*")) and not (self.at("async") and self.fresh_line(1)):
            accessor |= not self.at("async")
            self.i += 1
        star = self.take("*")
        plain = self.is_name()
        self.property_name()
        if self.at("(") or self.ts and self.at("<"):
            self.signature()
            self.body()
            return False
        if accessor or star:
            raise Broken
        if self.take(":"):
            return self.assignment() in _TARGETS
        if not plain:
            raise Broken
        if self.at("="):
            self.covers.append(self.i)
            self.i += 1
            self.assignment()
        return True

    # ---- types

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def close_angle(self) -> None:
        if not self.text().startswith(">"):
            raise Broken
        if len(self.text()) == 1:
            self.i, self.cut = self.i + 1, 0
        else:
            self.cut += 1

    def type_arguments(self) -> None:
        if self.at("<<"):  # f<<T>(x: T) => T>
            self.cut = 1
        else:
            self.need("<")
        if self.cut:
            self.cut = 0
            raise Broken
        self.type()
        while self.take(","):
            self.type()
        self.close_angle()

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.at("const", "in", "out") and self.kind(1) == "name" and self.text(1) != "extends":
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.at(">"):
                return self.close_angle()

    def type(self) -> None:
        saved = self.alternative, self.bare
        self.alternative = self.bare = False
        if self.at("asserts") and (self.is_name(1) or self.text(1) == "this") and not self.fresh_line(1):
            self.i += 2
            if self.take("is"):
                self.type()
        elif (self.is_name() or self.at("this")) and self.text(1) == "is" and not self.fresh_line(1):
            self.i += 2
            self.type()
        else:
            self.union()
            if self.at("extends") and not self.fresh_line():
                self.i += 1
                bare, self.bare = self.bare, True
                self.union()
                self.bare = bare
                if self.take("?"):
                    self.type()
                    self.need(":")
                    self.type()
                else:
                    raise Broken
        self.alternative, self.bare = saved

    def union(self) -> None:
        self.take("|", "&")
        while True:
            self.type_operand()
            if not self.take("|", "&"):
                return

    def type_operand(self) -> None:
        if self.at("new", "<") or self.at("abstract") and self.text(1) == "new" or self.at("(") and self.function_ahead():
            self.take("abstract")
            self.take("new")
            if self.at("<"):
                self.type_parameters()
            self.need("(")
            self.list_until(")", self.parameter)
            self.need("=>")
            return self.type()
        while self.at("keyof", "unique", "readonly", "infer") and (self.kind(1) in ("name", "string", "template") or self.text(1) in ("(", "[", "{")) and self.text(1) not in ("extends", "is", "in"):
            if self.take("infer"):
                self.name()
                if self.at("extends"):
                    self.tried(self.infer_bound)
                return self.type_suffixes()
            self.i += 1
        self.type_primary()
        self.type_suffixes()

    def infer_bound(self) -> bool:
        self.i += 1
        self.union()
        return self.bare or not self.at("?")

    def function_ahead(self) -> bool:
        """Whether the bracket here holds the parameters of a function type."""
        after = self.closing() + 1
        return after < self.n and self.t[after].text == "=>" and self.may_be_parameters(self.i)

    def type_suffixes(self) -> None:
        while self.at("[") and not self.fresh_line():
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def entity(self) -> None:
        self.need_kind("name")
        while self.take("."):
            self.need_kind("name", "private")

    def type_primary(self) -> None:
        kind, t = self.kind(), self.text()
        if kind in ("string", "number"):
            self.i += 1
        elif t == "-" and self.kind(1) == "number":
            self.i += 2
        elif kind == "template" and self.t[self.i].text == "`":
            self.i += 1
            while self.take("("):
                self.type()
                self.need(")")
            self.need_kind("template")
        elif t == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif t == "[":
            self.i += 1
            self.list_until("]", self.tuple_member)
        elif t == "{":
            self.object_type()
        elif t == "typeof":
            self.i += 1
            if self.at("import"):
                self.type_primary()
            else:
                self.entity()
            if self.at("<") and not self.fresh_line():
                self.type_arguments()
        elif t == "import":
            self.i += 1
            self.need("(")
            self.type()
            if self.take(","):
                self.expression_of(self.assignment)
            self.need(")")
            while self.take("."):
                self.need_kind("name")
            if self.at("<"):
                self.type_arguments()
        elif t in ("this", "null", "true", "false", "void", "*"):
            self.i += 1
        elif self.is_name():
            self.entity()
            if self.at("<") and not self.fresh_line():
                self.type_arguments()
        else:
            raise Broken

    def tuple_member(self) -> None:
        self.take("...")
        if self.kind() == "name" and (self.text(1) == ":" or self.text(1) == "?" and self.text(2) == ":"):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def index_signature(self) -> None:
        self.i += 3  # [ name :
        self.type()
        self.need("]")
        if self.take(":"):
            self.type()

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.type_member()
            if not self.take(";", ",") and not self.at("}") and not self.fresh_line():
                raise Broken

    def type_member(self) -> None:
        if self.at("+", "-") and self.text(1) == "readonly":
            self.i += 1
        while self.at("readonly", "get", "set", "static", "public", "private", "protected") and (self.kind(1) in ("name", "string", "number", "private") or self.text(1) == "["):
            self.i += 1
        if self.at("[") and self.is_name(1) and self.text(2) == ":":
            return self.index_signature()
        if self.at("[") and self.is_name(1) and self.text(2) == "in":  # a mapped type
            self.i += 3
            self.type()
            if self.take("as"):
                self.type()
            self.need("]")
            if self.take("+", "-"):
                self.need("?")
            else:
                self.take("?")
            if self.take(":"):
                self.type()
            return
        if self.at("new") and self.text(1) in ("(", "<"):
            self.i += 1
        if not self.at("(", "<"):
            self.property_name()
            self.take("?")
        if self.at("(", "<"):
            self.signature()
        elif self.take(":"):
            self.type()


_STATEMENTS = {
    "var": Grammar.variables, "const": Grammar.variables, "if": Grammar.if_, "for": Grammar.for_, "while": Grammar.while_, "do": Grammar.do, "return": Grammar.jump, "break": Grammar.jump,
    "continue": Grammar.jump, "throw": Grammar.jump, "switch": Grammar.switch, "try": Grammar.try_, "function": Grammar.function_statement, "class": Grammar.class_statement,
    "import": Grammar.import_, "export": Grammar.export, "with": Grammar.while_, "debugger": Grammar.debugger, "enum": Grammar.enum,
}
_DECLARED = set("var let const function class async import enum @ type interface namespace module abstract declare using global".split())
