"""Go."""

from __future__ import annotations

from quarrylight.llm.grammars.base import BLOCK, LINE, MARKER, REMEMBERED, STRING, WORD, Bad, Grammar, Reader

_TOKENS = rf"{MARKER}|{BLOCK}|{LINE}|{STRING}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?(?!\w)|0[bBoO][\d_]+i?(?!\w)|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?(?!\w)|{WORD}|:=|<-|\.\.\.|&\^=?|<<=|>>=|\+\+|--|&&|\|\||[+\-*/%&|^<>=!]=|<<|>>|\n|\S"
_KEYWORDS = set("package import func type var const struct interface map chan if for else switch select case default return break continue goto fallthrough go defer range".split())
_SIGNS = set("( ) [ ] { } , ; . : = + - * / % & | ^ < > ! ~ := <- ... ++ -- && || << >> &^ == != <= >= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_BINARY = set("+ - * / % & | ^ < > && || << >> &^ == != <= >=".split())
_ASSIGN = set("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_PREFIX = set("+ - * & ! ^ <- ~".split())
_ENDS = {"i", "v", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_KNOWN: set[tuple] = set()  # statements that have been read
_HEADS: set[tuple] = set()  # heads of if that have been read
_TYPE_START = {"i", "*", "[", "map", "chan", "func", "struct", "interface", "<-", "("}


def _kind(token: str) -> str:
    if token in _KEYWORDS or token in _SIGNS:
        return token
    if token == "\n":
        return "\n"
    c = token[0]
    if token.startswith(("//", "/*")):
        return "\n" if "\n" in token else ""
    if c in "\"'`" and len(token) > 1 or c.isdigit() or c == "." and len(token) > 1:
        return "v"
    return "i" if c.isidentifier() else "X"


class _Go(Reader):
    bare = False  # in the head of a statement, where a brace begins its block

    def attempt(self, rule) -> bool:
        bare = self.bare
        if super().attempt(rule):
            return True
        self.bare = bare
        return False

    def names(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")

    def ends(self) -> None:
        if self.k[self.p] not in (")", "}"):
            if self.k[self.p] != "" or self.p == 0:
                self.need(";")

    def file(self) -> None:
        k = self.k
        self.need("package")
        self.need("i")
        self.ends()
        while self.take("import"):
            self.group(self.import_)
            self.ends()
        while k[self.p]:
            if self.take(";"):
                continue
            t = k[self.p]
            if t == "func":
                self.p += 1
                if k[self.p] == "(":
                    self.params()
                self.need("i")
                self.type_params()
                self.signature()
                if k[self.p] == "{":
                    self.block()
            elif not self.declaration():
                raise Bad
            self.ends()

    def group(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                if self.take(";"):
                    continue
                rule()
                self.ends()
        else:
            rule()

    def import_(self) -> None:
        if self.k[self.p] in ("i", "."):
            self.p += 1
        self.need("v")

    def declaration(self) -> bool:
        t = self.k[self.p]
        if t == "var" or t == "const":
            self.p += 1
            self.group(self.variable)
        elif t == "type":
            self.p += 1
            self.group(self.type_spec)
        else:
            return False
        return True

    def variable(self) -> None:
        self.names()
        if self.k[self.p] in _TYPE_START:
            self.type()
        if self.take("="):
            self.exprs()

    def type_spec(self) -> None:
        self.need("i")
        k = self.k
        if k[self.p] == "[" and k[self.p + 1] == "i" and k[self.p + 2] not in ("]", "+", "-", "/", ".", "<<", ">>", "%"):
            at = self.p
            if not self.attempt(self.type_params) or k[self.p] not in _TYPE_START and k[self.p] != "=":
                self.p = at
        self.take("=")
        self.type()

    def type_params(self) -> None:
        if not self.take("["):
            return
        while not self.take("]"):
            self.names()
            self.constraint()
            if not self.take(","):
                self.need("]")
                return

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def type(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            self.p += 1
            if t == "*":
                continue
            if t == "i":
                if k[self.p] == "." and k[self.p + 1] == "i":
                    self.p += 2
                if k[self.p] == "[" and k[self.p + 1] != "]":
                    at = self.p
                    if not self.attempt(self.type_args):
                        self.p = at
                return
            if t == "[":
                if self.take("]"):
                    continue
                if not self.take("..."):
                    self.loose(self.expr)
                self.need("]")
                continue
            if t == "map":
                self.need("[")
                self.type()
                self.need("]")
                continue
            if t == "chan":
                self.take("<-")
                continue
            if t == "<-":
                self.need("chan")
                continue
            if t == "func":
                self.signature()
                return
            if t == "struct":
                self.fields()
                return
            if t == "interface":
                self.methods()
                return
            if t == "(":
                self.type()
                self.need(")")
                return
            raise Bad

    def type_args(self) -> None:
        self.need("[")
        self.type()
        while self.take(","):
            if self.k[self.p] == "]":
                break
            self.type()
        self.need("]")

    def fields(self) -> None:
        k = self.k
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if k[self.p] == "*" or k[self.p] == "(" or k[self.p] == "i" and k[self.p + 1] in (".", ";", "v", "}"):
                self.type()
            elif k[self.p] == "i" and k[self.p + 1] == "[" and k[self.p + 2] not in ("]", "v") and k[self.mate(self.p + 1) + 1] in (";", "v", "}"):
                self.type()
            else:
                self.names()
                self.type()
            self.take("v")
            self.ends()

    def methods(self) -> None:
        k = self.k
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if k[self.p] == "i" and k[self.p + 1] == "(":
                self.p += 1
                self.signature()
            else:
                self.constraint()
            self.ends()

    def signature(self) -> None:
        self.params()
        if self.k[self.p] == "(":
            self.params()
        elif self.k[self.p] in _TYPE_START:
            self.type()

    def params(self) -> None:
        k = self.k
        self.need("(")
        while not self.take(")"):
            if k[self.p] == "i":
                n = k[self.p + 1]
                if n == "...":
                    self.p += 2
                    self.type()
                elif n == "." or n == "," or n == ")":
                    self.type()
                elif n == "[":
                    self.p += 1
                    if k[self.p + 1] == "]" or k[self.p + 1] == "...":
                        self.type()
                    else:
                        self.p += 1
                        self.loose(self.arg)
                        while self.take(","):
                            self.arg()
                        self.need("]")
                        if k[self.p] not in (",", ")"):
                            self.type()
                else:
                    self.p += 1
                    self.type()
            else:
                self.take("...")
                self.type()
            if not self.take(","):
                self.need(")")
                return

    def loose(self, rule) -> None:
        """A rule within brackets, where braces are literals again."""
        bare, self.bare = self.bare, False
        rule()
        self.bare = bare

    def exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def expr(self) -> None:
        k = self.k
        while True:
            self.unary()
            if k[self.p] not in _BINARY:
                return
            self.p += 1

    def unary(self) -> None:
        k = self.k
        while k[self.p] in _PREFIX:
            if k[self.p] == "<-" and k[self.p + 1] == "chan":
                break
            self.p += 1
        t = k[self.p]
        if t == "v":
            self.p += 1
        elif t == "i":
            self.p += 1
            if k[self.p] == "{" and not self.bare:
                self.literal()
        elif t == "(":
            self.p += 1
            self.loose(self.arg)
            self.need(")")
        elif t == "func":
            self.p += 1
            self.signature()
            if k[self.p] == "{":
                self.loose(self.block)
        elif t in ("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            if k[self.p] == "{":
                self.literal()
        else:
            raise Bad
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                if k[self.p] == "i":
                    self.p += 1
                    if k[self.p] == "{" and not self.bare and k[self.p - 3] == "i":
                        self.literal()
                else:
                    self.need("(")
                    if not self.take("type"):
                        self.type()
                    self.need(")")
            elif t == "(":
                self.p += 1
                self.loose(self.args)
            elif t == "[":
                self.p += 1
                self.loose(self.index)
                if k[self.p] == "{" and not self.bare and k[self.p - 1] == "]":
                    self.literal()
            else:
                return

    def arg(self) -> None:
        """An expression or a type."""
        k = self.k
        t = k[self.p]
        if t in ("[", "map", "chan", "struct", "interface", "func") or t == "*":
            if not self.attempt(self.expr):
                self.type()
        else:
            self.expr()

    def args(self) -> None:
        while not self.take(")"):
            self.arg()
            self.take("...")
            if not self.take(","):
                self.need(")")
                return

    def index(self) -> None:
        k = self.k
        if k[self.p] != ":":
            self.arg()
        if self.take("]"):
            return
        if k[self.p] == ",":
            while self.take(","):
                if k[self.p] == "]":
                    break
                self.type()
            self.need("]")
            return
        self.need(":")
        if k[self.p] not in ("]", ":"):
            self.expr()
        if self.take(":"):
            self.expr()
        self.need("]")

    def literal(self) -> None:
        bare, self.bare = self.bare, False
        self.need("{")
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                self.need("}")
                break
        self.bare = bare

    def element(self) -> None:
        if self.k[self.p] == "{":
            self.literal()
        else:
            self.expr()

    def block(self) -> None:
        self.need("{")
        bare, self.bare = self.bare, False
        known = _KNOWN
        while not self.take("}"):
            if self.take(";"):
                continue
            short = self.recalled(";", known)
            if short is None:
                continue
            self.stmt()
            self.ends()
            if self.p == short[0] + 1 and len(known) < REMEMBERED:
                known.add(short[1])
        self.bare = bare

    def simple(self) -> None:
        k = self.k
        if self.take("range"):
            self.expr()
            return
        self.exprs()
        t = k[self.p]
        if t in _ASSIGN:
            self.p += 1
            self.take("range")
            self.exprs()
        elif t == "++" or t == "--":
            self.p += 1
        elif t == "<-":
            self.p += 1
            self.expr()

    def clause(self) -> None:
        """The head of an if or switch."""
        k = self.k
        bare, self.bare = self.bare, True
        if k[self.p] != "{":
            if k[self.p] != ";":
                self.simple()
            if self.take(";") and k[self.p] != "{":
                self.simple()
        self.bare = bare

    def stmt(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == "i":
            if k[self.p + 1] == ":":
                self.p += 2
                self.take(";")
                if k[self.p] != "}":
                    self.stmt()
            else:
                self.simple()
        elif t == "if":
            self.p += 1
            if k[self.p] == "{":
                raise Bad
            self.headed(self.clause, _HEADS)
            self.block()
            if self.take("else"):
                if k[self.p] == "if":
                    self.stmt()
                else:
                    self.block()
        elif t == "for":
            self.p += 1
            bare, self.bare = self.bare, True
            if k[self.p] != "{":
                if k[self.p] != ";":
                    self.simple()
                if self.take(";"):
                    if k[self.p] not in (";", "{"):
                        self.expr()
                    if self.take(";") and k[self.p] != "{":
                        self.simple()
            self.bare = bare
            self.block()
        elif t == "switch":
            self.p += 1
            self.clause()
            self.cases()
        elif t == "select":
            self.p += 1
            self.cases()
        elif t == "return":
            self.p += 1
            if k[self.p] not in (";", "}"):
                self.exprs()
        elif t in ("break", "continue", "goto"):
            self.p += 1
            self.take("i")
        elif t == "fallthrough":
            self.p += 1
        elif t == "go" or t == "defer":
            self.p += 1
            self.expr()
            if k[self.p - 1] != ")":
                raise Bad
        elif t == "{":
            self.block()
        elif not self.declaration():
            self.simple()

    def cases(self) -> None:
        k = self.k
        self.need("{")
        bare, self.bare = self.bare, False
        while not self.take("}"):
            if self.take("case"):
                self.arg()
                while self.take(","):
                    self.arg()
                if k[self.p] in _ASSIGN:
                    self.p += 1
                    self.expr()
                elif self.take("<-"):
                    self.expr()
            else:
                self.need("default")
            self.need(":")
            while k[self.p] not in ("case", "default", "}"):
                if self.take(";"):
                    continue
                self.stmt()
                self.ends()
        self.bare = bare


class _GoGrammar(Grammar):
    """Puts the semicolons that line ends stand for."""

    def lexed(self, tokens: list[str]) -> list[str]:
        all_ = list(filter(None, map(self.kinds.__getitem__, tokens)))
        out: list[str] = []
        at, size = 0, len(all_)
        while at < size:
            try:
                end = all_.index("\n", at)
            except ValueError:
                out += all_[at:]
                break
            out += all_[at:end]
            if end > at and out[-1] in _ENDS:
                out.append(";")
            at = end + 1
        return out


GO = _GoGrammar(_TOKENS, _kind, _Go, r"[^\S\n]*+")
