"""JavaScript and TypeScript. JSX is another language and not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from quarrylight.llm.grammars.base import BLOCK, END, HEADS, LINE, MARKER, REMEMBERED, SHORT, STRING, Bad, Kinds, Reader

_NAMED = r"[^\W\d][\w$]*|\$[\w$]*|\\u[\da-fA-F{}]+[\w$]*"
_TOKENS = re.compile(
    rf"[^\S\n\u2028\u2029]*+({MARKER}|{BLOCK}|{LINE}|{STRING}|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\$]|\\.|\$(?!\{{))*+`|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])|(?:{_NAMED}|(?<=\w)\\u[\da-fA-F{{}}]+)+|\#(?:{_NAMED})|=>|\.\.\.|===|!==|\*\*=?|\?\?=?|\?\.(?!\d)|&&=|\|\|=|<<=|\+\+|--|&&|\|\||[+\-*/%&|^<>=!]=|<<|[\n\u2028\u2029]|\S)",
    re.M | re.S,
)
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)

_KEYWORDS = set("var const function class extends if while with switch for else do return throw break continue new try catch finally import export case default this super in instanceof typeof void delete enum debugger".split())
_SOFT = set("let static get set of async await yield as from type interface namespace module declare abstract readonly public private protected keyof implements is infer satisfies asserts unique override accessor global out require target meta using constructor package".split())
_SIGNS = set("( ) [ ] { } , ; . : ? @ = + - * / % & | ^ < > ! ~ => ... === !== ** **= ?? ??= ?. &&= ||= ++ -- && || << == != <= >= += -= *= /= %= &= |= ^= <<=".split())
_BINARY = set("+ - * / % & | ^ < ** ?? && || << == != === !== <= >= in instanceof = += -= *= /= %= &= |= ^= <<= **= ??= &&= ||=".split())
_PREFIX = {"+", "-", "!", "~", "++", "--", "typeof", "void", "delete"}
_NAME = {"i"} | _SOFT
_WORDS = _NAME | _KEYWORDS | {"v", "null"}
#: Kinds after which a slash begins a regular expression.
_BEFORE_REGEX = (_SIGNS - {")", "]", "}", "++", "--"}) | {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "extends", "default", "yield", "await", "", "`{", "`}{"}
_END_STMT = {";", "}", ""}


def _kind(token: str) -> str:
    if token in _KEYWORDS or token in _SOFT or token in _SIGNS:
        return token
    if token in ("true", "false", "null"):
        return "null"
    c = token[0]
    if c in "\n\u2028\u2029":
        return "\n"
    if token.startswith(("//", "/*")):
        return "\n" if "\n" in token else " "
    if c in "\"'`" and len(token) > 1:
        return "s" if c != "`" else "`"
    if c.isdigit() or c == "." and len(token) > 1:
        return "n"
    if c == "#" and len(token) > 1:
        return "#"
    return "i" if c.isidentifier() or c in "$\\" and (c == "$" or len(token) > 1) else "X"


_KINDS = Kinds(_kind)


def _settled(tokens: list[str]) -> tuple[list[str], bytearray]:
    """Kinds, and whether a line ends before each."""
    all_ = list(map(_KINDS.__getitem__, tokens))
    if " " in all_:
        all_ = [kind for kind in all_ if kind != " "]
    if "\n" not in all_:
        return all_, bytearray(len(all_)) + b"\1" * len(END)
    kinds: list[str] = []
    marks, at, size = [], 0, len(all_)
    while at < size:
        try:
            end = all_.index("\n", at)
        except ValueError:
            end = size
        kinds += all_[at:end]
        marks.append(len(kinds))
        at = end + 1
    breaks = bytearray(len(kinds)) + b"\1" * len(END)
    for mark in marks:
        breaks[mark] = 1
    return kinds, breaks


_HEAD: tuple[str, list[str], Iterator[re.Match]] = ("", [], iter(()))


def lexed(text: str, most: int | None = None) -> tuple[list[str], bytearray]:
    """The kinds of a text; with ``most``, of its first tokens up to one that needs to know what is before it."""
    global _HEAD
    if most is not None:
        if _HEAD[0] != text:  # both grammars ask for the same beginnings
            _HEAD = (text, [], _TOKENS.finditer(text))
        tokens = _HEAD[1]
        while len(tokens) < most and (m := next(_HEAD[2], None)):
            if m[1] in ("/", "/=", "`"):
                _HEAD = (text, tokens, iter(()))
                break
            tokens.append(m[1])
        return _settled(tokens[:most])
    tokens = _TOKENS.findall(text)
    if "/" not in tokens and "/=" not in tokens and "`" not in tokens:
        return _settled(tokens)
    return _walked(text)


def _walked(text: str) -> tuple[list[str], bytearray]:
    """The kinds of a text with regular expressions or templates, from left to right."""
    kinds: list[str] = []
    breaks = bytearray()
    of, match = _KINDS, _TOKENS.search
    at, pending, last = 0, 0, ""
    open_: list[str] = []  # brackets that are open; "`" for the brace of a template
    closed = ""  # kind before the bracket that closed last
    before: list[str] = []
    while True:
        m = match(text, at)
        if m is None:
            break
        token = m[1]
        kind = of[token]
        at = m.end()
        if kind == " ":
            continue
        if kind == "\n":
            pending = 1
            continue
        if kind in ("/", "/="):
            start = last in _BEFORE_REGEX or last == ")" and closed in ("if", "while", "for", "with") or last == "}" and closed in ("=>", ")", ";", "{", "", "else", "do", "try", "finally") and pending == 1
            found = start and _REGEX.match(text, m.start(1))
            if found:
                kind, at = "r", found.end()
        elif kind in ("(", "[", "{"):
            open_.append(kind)
            before.append(last)
        elif kind in (")", "]", "}"):
            if kind == "}" and open_ and open_[-1] == "`":
                kind, at = _template(text, at)
                if kind == "`}":
                    open_.pop()
                    before.pop()
                elif kind == "X":
                    kinds.append(kind)
                    break
            elif open_:
                open_.pop()
                closed = before.pop()
        elif token == "`":
            kind, at = _template(text, at)
            if kind == "X":
                kinds.append(kind)
                break
            kind = "`{" if kind == "`}{" else "`"
            if kind == "`{":
                open_.append("`")
                before.append(last)
        kinds.append(kind)
        breaks.append(pending)
        pending, last = 0, kind
    breaks.extend(b"\1" * len(END))
    return kinds, breaks


def _template(text: str, at: int) -> tuple[str, int]:
    """The next part of a template: up to ${ or the end."""
    end = _TEMPLATE.match(text, at).end()
    if text.startswith("${", end):
        return "`}{", end + 2
    if text.startswith("`", end):
        return "`}", end + 1
    return "X", end


class _Script(Reader):
    typed = False
    known: set[tuple] = set()  # statements that have been read
    heads: set[tuple] = set()  # conditions that have been read
    no_in = False

    def __init__(self, kinds: list[str], breaks: bytearray) -> None:
        super().__init__(kinds)
        self.breaks = breaks
        self.no_arrow: set[int] = set()
        self.no_types: set[int] = set()
        self.no_args: set[int] = set()

    def forget(self) -> None:
        """Places have moved."""
        self._mates = None
        self.no_arrow.clear()
        self.no_types.clear()
        self.no_args.clear()

    def attempt(self, rule) -> bool:
        no_in = self.no_in
        if super().attempt(rule):
            return True
        self.no_in = no_in
        return False

    def name(self) -> None:
        if self.k[self.p] not in _NAME:
            raise Bad
        self.p += 1

    def word(self) -> None:
        if self.k[self.p] not in _WORDS:
            raise Bad
        self.p += 1

    def semicolon(self) -> None:
        if self.take(";") or self.k[self.p] in _END_STMT or self.breaks[self.p]:
            return
        raise Bad

    def file(self) -> None:
        k = self.k
        while k[self.p]:
            self.stmt()

    # ---- statements

    def block(self) -> None:
        k = self.k
        self.need("{")
        no_in, self.no_in = self.no_in, False
        known, breaks = self.known, self.breaks
        while k[self.p] != "}":
            at = self.p
            short = self.recalled(";", known)
            if short is None:
                if breaks.find(1, at + 1, self.p) < 0:
                    continue
                self.p, short = at, (-1, ())  # a line that ends within may end a statement
            self.stmt()
            if self.p == short[0] + 1 and len(known) < REMEMBERED and breaks.find(1, at + 1, self.p) < 0:
                known.add(short[1])
        self.p += 1
        self.no_in = no_in

    def condition(self) -> None:
        self.need("(")
        self.exprs()
        self.need(")")

    def stmt(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == "{":
            self.block()
        elif t == ";":
            self.p += 1
        elif t == "await" and k[self.p + 1] == "using" and k[self.p + 2] in _NAME and not self.breaks[self.p + 2]:
            self.p += 2
            self.variables()
            self.semicolon()
        elif t == "var" or t == "const" or t == "let" and (k[self.p + 1] in _NAME and (k[self.p + 1] != "of" or k[self.p + 2] in ("=", ";", ",")) or k[self.p + 1] in ("[", "{")) or t == "using" and k[self.p + 1] in _NAME and k[self.p + 2] == "=" and not self.breaks[self.p + 1]:
            if t == "const" and k[self.p + 1] == "enum" and self.typed:
                self.p += 1
                self.enum()
                return
            self.p += 1
            self.variables()
            self.semicolon()
        elif t == "function" or t == "async" and k[self.p + 1] == "function" and not self.breaks[self.p + 1]:
            self.function(True)
        elif t == "class" or t == "@":
            self.decorators()
            if k[self.p] == "export":
                self.stmt()
            else:
                if self.typed:
                    self.take("abstract")
                self.class_()
        elif t == "if":
            self.p += 1
            brace = k.index("{", self.p) if "{" in k[self.p : self.p + SHORT] else self.p
            if self.breaks.find(1, self.p, brace) < 0 and brace > self.p:
                self.headed(self.condition, self.heads)
            else:
                self.condition()
            self.stmt()
            if self.take("else"):
                self.stmt()
        elif t == "while" or t == "with":
            self.p += 1
            self.condition()
            self.stmt()
        elif t == "for":
            self.p += 1
            self.take("await")
            self.need("(")
            self.for_head()
            self.need(")")
            self.stmt()
        elif t == "do":
            self.p += 1
            self.stmt()
            self.need("while")
            self.condition()
            self.take(";")
        elif t == "return" or t == "throw":
            self.p += 1
            if k[self.p] not in _END_STMT and not self.breaks[self.p]:
                self.exprs()
            elif t == "throw":
                raise Bad
            self.semicolon()
        elif t == "break" or t == "continue":
            self.p += 1
            if k[self.p] in _NAME and not self.breaks[self.p]:
                self.p += 1
            self.semicolon()
        elif t == "switch":
            self.p += 1
            self.condition()
            self.need("{")
            while not self.take("}"):
                if self.take("case"):
                    self.exprs()
                else:
                    self.need("default")
                self.need(":")
                while k[self.p] not in ("case", "default", "}"):
                    self.stmt()
        elif t == "try":
            self.p += 1
            self.block()
            n = 0
            if self.take("catch"):
                n = 1
                if self.take("("):
                    self.binding()
                    self.annotation()
                    self.need(")")
                self.block()
            if self.take("finally"):
                n = 1
                self.block()
            if not n:
                raise Bad
        elif t == "import" and k[self.p + 1] not in ("(", "."):
            self.import_()
        elif t == "export":
            self.export()
        elif t == "debugger":
            self.p += 1
            self.semicolon()
        elif t in _NAME and k[self.p + 1] == ":":
            self.p += 2
            self.stmt()
        elif self.typed and (t in _SOFT or t == "enum") and self.declaration():
            pass
        else:
            self.exprs()
            self.semicolon()

    def for_head(self) -> None:
        k, t = self.k, self.k[self.p]
        self.no_in = True
        if t == ";":
            pass
        elif t in ("var", "const") or t == "let" and (k[self.p + 1] in _NAME or k[self.p + 1] in ("[", "{")) or t == "using" and k[self.p + 1] == "i":
            self.p += 1
            self.binding()
            self.annotation()
            if k[self.p] not in ("of", "in"):
                if self.take("="):
                    self.expr()
                while self.take(","):
                    self.variable()
        else:
            self.exprs()
        self.no_in = False
        if self.take("of"):
            self.expr()
        elif self.take("in"):
            self.exprs()
        else:
            self.need(";")
            if k[self.p] != ";":
                self.exprs()
            self.need(";")
            if k[self.p] != ")":
                self.exprs()

    def variables(self) -> None:
        self.variable()
        while self.take(","):
            self.variable()

    def variable(self) -> None:
        self.binding()
        if self.typed:
            self.take("!")
        self.annotation()
        if self.take("="):
            self.expr()

    def binding(self) -> None:
        k, t = self.k, self.k[self.p]
        if t in _NAME:
            self.p += 1
        elif t == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.element()
                if not self.take(","):
                    self.need("]")
                    return
        elif t == "{":
            self.p += 1
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                elif k[self.p] in _NAME and k[self.p + 1] != ":":
                    self.p += 1
                    if self.take("="):
                        self.inner()
                else:
                    self.key()
                    self.need(":")
                    self.element()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            raise Bad

    def element(self) -> None:
        self.binding()
        if self.take("="):
            self.inner()

    def inner(self) -> None:
        """An expression within brackets, where ``in`` is an operator again."""
        no_in, self.no_in = self.no_in, False
        self.expr()
        self.no_in = no_in

    def key(self) -> None:
        k, t = self.k, self.k[self.p]
        if t in _WORDS or t in ("s", "n", "#"):
            self.p += 1
        elif t == "[":
            self.p += 1
            no_in, self.no_in = self.no_in, False
            self.exprs()
            self.no_in = no_in
            self.need("]")
        else:
            raise Bad

    def import_(self) -> None:
        k = self.k
        self.p += 1
        if self.typed and k[self.p] == "type" and (k[self.p + 1] in ("{", "*") or k[self.p + 1] in _NAME and k[self.p + 1] != "from" or k[self.p + 1] == "from" and k[self.p + 2] == "from"):
            self.p += 1
        if self.typed and k[self.p] in _NAME and k[self.p + 1] == "=":
            self.p += 2
            self.exprs()
            self.semicolon()
            return
        if not self.take("s"):
            if k[self.p] in _NAME and not (k[self.p] == "from" and k[self.p + 1] == "s"):
                self.p += 1
                if k[self.p] != "from":
                    self.need(",")
                    if k[self.p] not in ("{", "*"):
                        raise Bad
            if self.take("*"):
                self.need("as")
                self.name()
            elif k[self.p] == "{":
                self.specifiers()
            self.need("from")
            self.need("s")
        self.attributes()
        self.semicolon()

    def attributes(self) -> None:
        k = self.k
        if (k[self.p] == "with" or k[self.p] == "i" and not self.breaks[self.p]) and k[self.p + 1] == "{":
            self.p += 1
            self.object()

    def specifiers(self) -> None:
        k = self.k
        self.need("{")
        while not self.take("}"):
            if self.typed and k[self.p] == "type" and k[self.p + 1] not in (",", "}", "as"):
                self.p += 1
            if not self.take("s"):
                self.word()
            if self.take("as"):
                if not self.take("s"):
                    self.word()
            if not self.take(","):
                self.need("}")
                return

    def export(self) -> None:
        k = self.k
        self.p += 1
        t = k[self.p]
        if self.typed and t == "type" and k[self.p + 1] in ("{", "*"):
            self.p += 1
            t = k[self.p]
        if t == "{":
            self.specifiers()
            if self.take("from"):
                self.need("s")
                self.attributes()
            self.semicolon()
        elif t == "*":
            self.p += 1
            if self.take("as") and not self.take("s"):
                self.word()
            self.need("from")
            self.need("s")
            self.attributes()
            self.semicolon()
        elif t == "default":
            self.p += 1
            t = k[self.p]
            if t == "function" or t == "async" and k[self.p + 1] == "function":
                self.function(False)
            elif t in ("class", "@") or t == "abstract" and k[self.p + 1] == "class":
                self.decorators()
                self.take("abstract")
                self.class_()
            elif self.typed and t == "interface" and k[self.p + 1] in _NAME:
                self.declaration()
            else:
                self.expr()
                self.semicolon()
        elif self.typed and t == "=":
            self.p += 1
            self.expr()
            self.semicolon()
        elif self.typed and t == "as":
            self.p += 1
            self.need("namespace")
            self.name()
            self.semicolon()
        elif t in ("var", "const", "let", "function", "class", "async", "@", "import", "enum") or self.typed and t in _SOFT:
            self.stmt()
        else:
            raise Bad

    def function(self, named: bool) -> None:
        self.take("async")
        self.need("function")
        self.take("*")
        if self.k[self.p] in _NAME:
            self.p += 1
        elif named:
            raise Bad
        self.signature()
        if self.k[self.p] == "{":
            self.block()
        elif self.typed:
            self.semicolon()
        else:
            raise Bad

    def signature(self) -> None:
        self.type_params()
        self.params()
        self.returns()

    def params(self) -> None:
        k = self.k
        self.need("(")
        while not self.take(")"):
            if k[self.p] == "@":
                self.decorators()
            if self.typed:
                while k[self.p] in ("public", "private", "protected", "readonly", "override") and (k[self.p + 1] in _NAME or k[self.p + 1] in ("{", "[")):
                    self.p += 1
                if k[self.p] == "this":
                    self.p += 1
                    self.annotation()
                    if not self.take(","):
                        self.need(")")
                        return
                    continue
            self.take("...")
            self.binding()
            if self.typed:
                self.take("?")
            self.annotation()
            if self.take("="):
                self.inner()
            if not self.take(","):
                self.need(")")
                return

    def decorators(self) -> None:
        k = self.k
        while self.take("@"):
            if k[self.p] == "(":
                self.condition()
                continue
            self.name()
            while self.take("."):
                self.word()
            if self.typed and k[self.p] == "<":
                self.type_args()
            if k[self.p] == "(":
                self.args()

    def class_(self) -> None:
        k = self.k
        self.need("class")
        if k[self.p] in _NAME and k[self.p] != "implements":
            self.p += 1
        self.type_params()
        if self.take("extends"):
            self.primary()
            self.postfix()
            if self.typed and k[self.p] == "<":
                self.type_args()
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        no_in, self.no_in = self.no_in, False
        while not self.take("}"):
            if not self.take(";"):
                self.member()
        self.no_in = no_in

    def member(self) -> None:
        k = self.k
        self.decorators()
        if k[self.p] == "static" and k[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        prefixes = ("static", "async", "get", "set", "accessor", "public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ("static", "async", "get", "set", "accessor")
        while k[self.p] in prefixes and k[self.p + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", "") and not (self.breaks[self.p + 1] and k[self.p] in ("get", "set", "async", "accessor") and k[self.p + 1] == "}"):
            self.p += 1
        self.take("*")
        if self.typed and k[self.p] == "[" and k[self.p + 1] in _NAME and k[self.p + 2] == ":":
            self.index_signature()
            self.semicolon()
            return
        self.key()
        if self.typed and k[self.p] in ("?", "!"):
            self.p += 1
        if k[self.p] in ("(", "<"):
            self.signature()
            if k[self.p] == "{":
                self.block()
            elif self.typed:
                self.semicolon()
            else:
                raise Bad
            return
        self.annotation()
        if self.take("="):
            self.expr()
        self.semicolon()

    # ---- expressions

    def exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def expr(self) -> None:
        k = self.k
        while True:
            while True:
                t = k[self.p]
                if t in _PREFIX:
                    self.p += 1
                elif t == "await" and (k[self.p + 1] in _WORDS or k[self.p + 1] in ("(", "[", "{", "s", "`", "`{", "n")) and k[self.p + 1] not in ("in", "instanceof", "of") and not self.breaks[self.p + 1]:
                    self.p += 1
                elif self.typed and t == "<" and self.assertion():
                    pass
                else:
                    break
            if t == "yield" and not self.breaks[self.p + 1] and k[self.p + 1] not in _BINARY - {"*", "+", "-"} and k[self.p + 1] not in (".", "=>"):
                self.p += 1
                self.take("*")
                if k[self.p] in (")", "]", "}", ",", ";", ":", "", "in", "of") or self.breaks[self.p]:
                    if k[self.p] == "?":
                        raise Bad
                else:
                    self.expr()
                return
            if self.arrow():
                return
            self.primary()
            self.postfix()
            if k[self.p] in ("++", "--") and not self.breaks[self.p]:
                self.p += 1
            while True:
                t = k[self.p]
                if t == ">":
                    self.p += 1
                    while k[self.p] in (">", ">="):
                        self.p += 1
                    break
                if t in _BINARY:
                    if t == "in" and self.no_in:
                        return
                    self.p += 1
                    break
                if t == "?":
                    self.p += 1
                    self.inner()
                    self.need(":")
                    break
                if self.typed and t in ("as", "satisfies") and not self.breaks[self.p]:
                    self.p += 1
                    if not self.take("const"):
                        self.type()
                    continue
                return

    def assertion(self) -> bool:
        """A type in angle brackets before a value, or the type parameters of an arrow function (read with it)."""
        if self.p in self.no_types:
            return False
        at = self.p

        def rule() -> None:
            self.need("<")
            if not self.take("const"):
                self.type()
            self.need(">")

        if self.attempt(rule) and not (self.k[self.p] == "(" and self.k[self.mate(self.p) + 1] in ("=>", ":")):
            return True
        self.p = at
        self.no_types.add(at)
        return False

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        k, at = self.k, self.p
        t = k[at]
        if t == "async" and not self.breaks[at + 1] and (k[at + 1] in _NAME and k[at + 2] == "=>" or k[at + 1] in ("(", "<")):
            at += 1
            t = k[at]
        if t in _NAME:
            if k[at + 1] != "=>" or self.breaks[at + 1]:
                return False
            self.p = at + 2
            self.arrow_body()
            return True
        if t == "(":
            n = k[self.mate(at) + 1]
            if n != "=>" and not (self.typed and n == ":"):
                return False
        elif not (t == "<" and self.typed):
            return False
        if at in self.no_arrow:
            return False
        start = self.p

        def rule() -> None:
            self.p = at
            self.signature()
            self.need("=>")
            if n == ":":
                self.arrow_body()

        n = ":" if t == "<" else n
        if self.attempt(rule):
            if n != ":":
                self.arrow_body()
            return True
        self.p = start
        self.no_arrow.add(at)
        return False

    def arrow_body(self) -> None:
        if self.k[self.p] == "{":
            self.block()
        else:
            self.expr()

    def primary(self) -> None:
        k, t = self.k, self.k[self.p]
        if t in _NAME:
            if t == "async" and k[self.p + 1] == "function" and not self.breaks[self.p + 1]:
                self.function(False)
                return
            self.p += 1
        elif t in ("s", "n", "`", "r", "this", "null", "super", "#"):
            self.p += 1
        elif t == "(":
            self.p += 1
            no_in, self.no_in = self.no_in, False
            self.exprs()
            self.no_in = no_in
            self.need(")")
        elif t == "[":
            self.p += 1
            no_in, self.no_in = self.no_in, False
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.expr()
                if not self.take(","):
                    self.need("]")
                    break
            self.no_in = no_in
        elif t == "{":
            self.object()
        elif t == "function":
            self.function(False)
        elif t == "class" or t == "@":
            self.decorators()
            self.class_()
        elif t == "new":
            self.p += 1
            if self.take("."):
                self.need("target")
                return
            self.primary()
            while True:
                if k[self.p] == ".":
                    self.p += 1
                    if not self.take("#"):
                        self.word()
                elif k[self.p] == "[":
                    self.p += 1
                    self.exprs()
                    self.need("]")
                else:
                    break
            if self.typed and k[self.p] == "<":
                self.attempt(self.type_args)
            if k[self.p] == "(":
                self.args()
        elif t == "import":
            self.p += 1
            if self.take("."):
                self.word()
                if k[self.p] == "(":
                    self.args()
            else:
                self.args()
        elif t == "`{":
            self.template()
        else:
            raise Bad

    def template(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.need("`{")
        while True:
            self.exprs()
            if self.take("`}"):
                break
            self.need("`}{")
        self.no_in = no_in

    def object(self) -> None:
        k = self.k
        self.need("{")
        no_in, self.no_in = self.no_in, False
        while not self.take("}"):
            if self.take("..."):
                self.expr()
            else:
                while k[self.p] in ("async", "get", "set") and k[self.p + 1] not in ("(", ":", ",", "}", "=", "<") and not (k[self.p] == "async" and self.breaks[self.p + 1]):
                    self.p += 1
                self.take("*")
                name = k[self.p] in _NAME
                self.key()
                t = k[self.p]
                if t == ":":
                    self.p += 1
                    self.expr()
                elif t == "(" or t == "<":
                    self.signature()
                    self.block()
                elif t == "=" and name:
                    self.p += 1
                    self.expr()
                elif not name:
                    raise Bad
            if not self.take(","):
                self.need("}")
                break
        self.no_in = no_in

    def args(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("...")
            self.expr()
            if not self.take(","):
                self.need(")")
                break
        self.no_in = no_in

    def postfix(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                if not self.take("#"):
                    self.word()
            elif t == "(":
                self.args()
            elif t == "[":
                self.p += 1
                no_in, self.no_in = self.no_in, False
                self.exprs()
                self.no_in = no_in
                self.need("]")
            elif t == "?.":
                self.p += 1
                if k[self.p] not in ("(", "[", "`", "`{"):
                    if self.typed and k[self.p] == "<":
                        self.type_args()
                    elif not self.take("#"):
                        self.word()
            elif t == "`":
                self.p += 1
            elif t == "`{":
                self.template()
            elif self.typed and t == "!" and not self.breaks[self.p]:
                self.p += 1
            elif self.typed and t == "<" and self.p not in self.no_types:
                at = self.p
                if not self.attempt(self.type_args) or k[self.p] not in ("(", "`", "`{", ")", "]", ",", ";", ":", ".", "?.", "}", "", "=", "==", "===") and not self.breaks[self.p]:
                    self.p = at
                    self.no_types.add(at)
                    return
            else:
                return

    # ---- what only TypeScript has

    def annotation(self) -> None:
        pass

    def returns(self) -> None:
        pass

    def type_params(self) -> None:
        pass

    def declaration(self) -> bool:
        return False


class _Typed(_Script):
    typed = True
    known: set[tuple] = set()
    heads: set[tuple] = set()

    def annotation(self) -> None:
        if self.take(":"):
            self.type()

    def returns(self) -> None:
        if self.take(":"):
            self.return_type()

    def return_type(self) -> None:
        k = self.k
        if k[self.p] == "asserts" and (k[self.p + 1] in _NAME or k[self.p + 1] == "this") and k[self.p + 1] != "is" and not self.breaks[self.p + 1]:
            self.p += 2
            if self.take("is"):
                self.type()
            return
        if (k[self.p] in _NAME or k[self.p] == "this") and k[self.p + 1] == "is" and not self.breaks[self.p + 1]:
            self.p += 2
        self.type()

    def type_params(self) -> None:
        k = self.k
        if not self.take("<"):
            return
        while not self.take(">"):
            while k[self.p] in ("in", "out", "const") and (k[self.p + 1] in _NAME or k[self.p + 1] == "in"):
                self.p += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                self.need(">")
                return

    def type_args(self) -> None:
        at = self.p
        if at in self.no_args:
            raise Bad
        try:
            self.type_list()
        except Bad:
            self.no_args.add(at)
            raise

    def type_list(self) -> None:
        k = self.k
        if k[self.p] == "<<":
            k[self.p : self.p + 1] = ["<", "<"]
            self.breaks.insert(self.p, 0)
            self.forget()
        self.need("<")
        while True:
            self.type()
            if self.take(">"):
                return
            if k[self.p] == ">=":
                k[self.p : self.p + 1] = [">", "="]
                self.breaks.insert(self.p, 0)
                self.forget()
                self.p += 1
                return
            self.need(",")

    def type(self) -> None:
        k = self.k
        no_in, self.no_in = self.no_in, False
        self.union()
        if k[self.p] == "extends":
            at = self.p
            self.p += 1
            self.union()
            if self.take("?"):
                self.type()
                self.need(":")
                self.type()
            else:
                self.p = at
        self.no_in = no_in

    def union(self) -> None:
        k = self.k
        if k[self.p] in ("|", "&"):
            self.p += 1
        while True:
            self.postfix_type()
            if k[self.p] not in ("|", "&"):
                return
            self.p += 1

    def postfix_type(self) -> None:
        k = self.k
        while k[self.p] in ("keyof", "unique", "readonly", "infer", "asserts") and (k[self.p + 1] in _WORDS or k[self.p + 1] in ("(", "[", "{", "s", "`", "`{")) and k[self.p + 1] not in ("extends", "is") or k[self.p] == "typeof" and k[self.p + 1] == "import":
            self.p += 1
            if k[self.p - 1] == "infer":
                self.name()
                if self.take("extends"):
                    self.union()
                return
        self.primary_type()
        while k[self.p] == "[" and not self.breaks[self.p]:
            self.p += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def primary_type(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == "abstract" and k[self.p + 1] == "new":
            self.p += 1
            t = "new"
        if t == "new":
            self.p += 1
            self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
        elif t == "<":
            self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
        elif t == "(":
            if k[self.mate(self.p) + 1] == "=>":
                at = self.p

                def rule() -> None:
                    self.params()
                    self.need("=>")
                    self.return_type()

                if at not in self.no_arrow and self.attempt(rule):
                    return
                self.no_arrow.add(at)
            self.p += 1
            self.type()
            self.need(")")
        elif t in _NAME or t == "this" or t == "void":
            if t == "this" and k[self.p + 1] == "is":
                self.p += 2
                self.type()
                return
            self.p += 1
            while k[self.p] == "." and (k[self.p + 1] in _WORDS):
                self.p += 2
            if k[self.p] in ("<", "<<") and not self.breaks[self.p]:
                self.type_args()
        elif t in ("s", "n", "null", "`"):
            self.p += 1
        elif t == "-":
            self.p += 1
            self.need("n")
        elif t == "`{":
            self.p += 1
            while True:
                self.type()
                if self.take("`}"):
                    return
                self.need("`}{")
        elif t == "typeof":
            self.p += 1
            self.word()
            while k[self.p] == "." and (k[self.p + 1] in _WORDS or k[self.p + 1] == "#"):
                self.p += 2
            if k[self.p] == "<" and not self.breaks[self.p]:
                self.type_args()
        elif t == "import":
            self.p += 1
            self.args()
            while k[self.p] == ".":
                self.p += 1
                self.word()
            if k[self.p] == "<":
                self.type_args()
        elif t == "[":
            self.p += 1
            while not self.take("]"):
                self.take("...")
                if k[self.p] in _WORDS and (k[self.p + 1] == ":" or k[self.p + 1] == "?" and k[self.p + 2] == ":"):
                    self.p += 2
                    self.take(":")
                self.type()
                self.take("?")
                if not self.take(","):
                    self.need("]")
                    return
        elif t == "{":
            self.members()
        else:
            raise Bad

    def index_signature(self) -> None:
        self.p += 3
        self.type()
        self.need("]")
        if self.k[self.p] in ("?", "!"):
            self.p += 1
        self.annotation()

    def members(self) -> None:
        k = self.k
        self.need("{")
        if self.mapped():
            return
        while not self.take("}"):
            while k[self.p] in ("readonly", "get", "set", "static", "public", "private", "async") and k[self.p + 1] not in ("(", ":", "?", ";", ",", "}", "<") and not self.breaks[self.p + 1]:
                self.p += 1
            if k[self.p] == "[" and k[self.p + 1] in _NAME and k[self.p + 2] == ":":
                self.index_signature()
            else:
                if k[self.p] == "new" and k[self.p + 1] in ("(", "<"):
                    self.p += 1
                elif k[self.p] not in ("(", "<"):
                    self.key()
                    self.take("?")
                if k[self.p] in ("(", "<"):
                    self.signature()
                else:
                    self.annotation()
            if not (self.take(",") or self.take(";")) and k[self.p] != "}" and not self.breaks[self.p]:
                raise Bad

    def mapped(self) -> bool:
        k, at = self.k, self.p
        if k[at] in ("+", "-"):
            at += 1
        if k[at] == "readonly":
            at += 1
        if not (k[at] == "[" and k[at + 1] in _NAME and k[at + 2] == "in"):
            return False
        self.p = at + 3
        self.type()
        if self.take("as"):
            self.type()
        self.need("]")
        if k[self.p] in ("+", "-"):
            self.p += 1
        self.take("?")
        self.annotation()
        if not self.take(";"):
            self.take(",")
        self.need("}")
        return True

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.take("}"):
            self.key()
            if self.take("="):
                self.expr()
            if not self.take(","):
                self.need("}")
                return

    def declaration(self) -> bool:
        """A declaration that begins with a word that is no keyword."""
        k, t, n = self.k, self.k[self.p], self.k[self.p + 1]
        apart = self.breaks[self.p + 1]
        if t == "interface" and n in _NAME and not apart:
            self.p += 2
            self.type_params()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.members()
        elif t == "type" and n in _NAME and not apart and k[self.p + 2] in ("=", "<"):
            self.p += 2
            self.type_params()
            self.need("=")
            self.type()
            self.semicolon()
        elif t == "enum":
            self.enum()
        elif t in ("namespace", "module") and (n in _NAME or n == "s") and not apart:
            self.p += 2
            while self.take("."):
                self.name()
            if k[self.p] == "{":
                self.block()
            else:
                self.semicolon()
        elif t == "global" and n == "{":
            self.p += 1
            self.block()
        elif t == "abstract" and n == "class":
            self.p += 1
            self.class_()
        elif t == "declare" and (n in _NAME or n in ("var", "const", "function", "class", "enum", "import")) and not apart:
            self.p += 1
            self.stmt()
        else:
            return False
        return True


_LAST: tuple[str, list[str], bytearray] = ("", [], bytearray(b"\1" * len(END)))


class ScriptGrammar:
    def __init__(self, reader: type[_Script]) -> None:
        self.reader = reader
        self.tokens, self.kinds = _TOKENS, _KINDS

    def whole(self, text: str) -> list[str]:
        return lexed(_bare(text))[0]

    def make(self, text: str) -> _Script:
        global _LAST
        if _LAST[0] != text:  # both grammars read the same tokens
            _LAST = (text, *lexed(_bare(text)))
        return self.reader([*_LAST[1], *END], _LAST[2][:])

    def valid(self, text: str) -> bool:
        reader = self.make(text)
        if "X" in reader.k:
            return False
        try:
            reader.file()
        except (Bad, IndexError):
            return False
        return True

    def foreign(self, text: str) -> bool:
        for most in HEADS:
            try:
                self.reader(*lexed(_bare(text), most)).file()
            except Bad:
                return False
            except IndexError:
                pass
        return self.valid(text)


def _bare(text: str) -> str:
    """Without the line that names an interpreter."""
    return text[text.find("\n") :] if text.startswith("#!") and "\n" in text else "" if text.startswith("#!") else text


JS, TS = ScriptGrammar(_Script), ScriptGrammar(_Typed)
