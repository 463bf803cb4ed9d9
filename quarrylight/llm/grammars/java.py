"""Java, up to records, sealed types, text blocks, switch expressions and patterns."""

from __future__ import annotations

from quarrylight.llm.grammars.base import BLOCK, LINE, MARKER, REMEMBERED, STRING, WORD, Bad, Grammar, Reader

_TOKENS = rf"{MARKER}|{BLOCK}|{LINE}|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{STRING}|'(?:[^'\\\n]|\\[^\n]+?)'|0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?(?![\w$])|0[bB][01_]+[lL]?(?![\w$])|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?(?![\w$])|non-sealed\b|[^\W\d][\w$]*|\$[\w$]*|->|::|\.\.\.|<<=|\+\+|--|&&|\|\||[+\-*/%&|^<>=!]=|<<|\S"
_PRIMITIVES = set("int long short byte char float double boolean".split())
_MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
_KEYWORDS = set("class interface enum record if while switch for else do return throw break continue new try catch finally package import extends implements throws permits case instanceof void this super assert yield when".split())
_SIGNS = set("( ) [ ] { } , ; . : ? @ = + - * / % & | ^ < > ! ~ -> :: ... ++ -- && || << == != <= >= += -= *= /= %= &= |= ^= <<=".split())
_BINARY = set("+ - * / % & | ^ < > && || << == != <= >= = += -= *= /= %= &= |= ^= <<=".split())
_PREFIX = set("+ - ! ~ ++ --".split())
_NAME = {"i", "record", "permits", "yield", "when", "sealed"}
_KNOWN: set[tuple] = set()  # statements that have been read
_HEADS: set[tuple] = set()  # conditions that have been read
_AFTER_CAST = _NAME | {"v", "(", "!", "~", "this", "super", "new", "t", "void", "switch"}


def _kind(token: str) -> str:
    if token in _PRIMITIVES:
        return "t"
    if token in ("true", "false", "null"):
        return "v"
    if token in ("const", "goto"):
        return "X"
    if token in _MODIFIERS or token in _KEYWORDS or token in _SIGNS:
        return token
    c = token[0]
    if token.startswith(("//", "/*")):
        return ""
    if c in "\"'" and len(token) > 1 or c.isdigit() or c == "." and len(token) > 1:
        return "v"
    return "i" if c.isidentifier() or c == "$" else "X"


class _Java(Reader):
    untyped = -1  # a place before which no type arguments can begin, as an attempt has shown
    case = False  # in the label of a case, where an arrow ends it

    def name(self) -> None:
        if self.k[self.p] not in _NAME:
            raise Bad
        self.p += 1

    def path(self) -> None:
        self.name()
        while self.k[self.p] == "." and self.k[self.p + 1] in _NAME:
            self.p += 2

    def file(self) -> None:
        k = self.k
        at = self.p
        self.annotations()
        if self.take("package"):
            self.path()
            self.need(";")
        else:
            self.p = at
        while k[self.p] in ("import", ";"):
            if self.take(";"):
                continue
            self.p += 1
            self.take("static")
            self.path()
            if self.take("."):
                self.need("*")
            self.need(";")
        if k[self.p] == "i" and k[self.p + 1] in _NAME or k[self.p] == "i" and k[self.p + 1] == "{":
            self.module()
            return
        while k[self.p]:
            if self.take(";"):
                continue
            self.modifiers()
            if not self.type_declaration():
                raise Bad

    def module(self) -> None:
        self.name()
        if self.k[self.p] in _NAME:
            self.path()
        self.need("{")
        while not self.take("}"):
            while not self.take(";"):
                if self.k[self.p] not in _NAME and self.k[self.p] not in (".", ",", "static"):
                    raise Bad
                self.p += 1

    def annotations(self) -> None:
        while self.k[self.p] == "@" and self.k[self.p + 1] != "interface":
            self.p += 1
            self.path()
            if self.take("("):
                if not self.take(")"):
                    self.element()
                    while self.take(","):
                        self.element()
                    self.need(")")

    def element(self) -> None:
        k = self.k
        if k[self.p] in _NAME and k[self.p + 1] == "=":
            self.p += 2
        if k[self.p] == "@":
            self.annotations()
        elif self.take("{"):
            while not self.take("}"):
                self.element()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.expr()

    def modifiers(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t == "@" and k[self.p + 1] != "interface":
                self.annotations()
            elif t in _MODIFIERS:
                if t == "sealed" and k[self.p + 1] not in _MODIFIERS and k[self.p + 1] not in ("class", "interface", "@"):
                    return
                if t == "default" and k[self.p + 1] in (":", "->"):
                    return
                self.p += 1
            else:
                return

    def type_declaration(self) -> bool:
        k, t = self.k, self.k[self.p]
        if t == "class" or t == "interface":
            self.p += 1
            self.name()
            self.type_params()
        elif t == "enum":
            self.p += 1
            self.name()
        elif t == "record" and k[self.p + 1] in _NAME and k[self.p + 2] in ("(", "<"):
            self.p += 1
            self.name()
            self.type_params()
            self.need("(")
            self.params()
        elif t == "@" and k[self.p + 1] == "interface":
            self.p += 2
            self.name()
        else:
            return False
        while k[self.p] in ("extends", "implements", "permits"):
            self.p += 1
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        if t == "enum":
            self.constants()
        self.body()
        return True

    def constants(self) -> None:
        k = self.k
        while k[self.p] not in (";", "}"):
            self.annotations()
            self.name()
            if self.take("("):
                self.args()
            if self.take("{"):
                self.body()
            if not self.take(","):
                break
        if k[self.p] != "}":
            self.need(";")

    def type_params(self) -> None:
        if not self.take("<"):
            return
        while True:
            self.annotations()
            self.name()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if self.take(">"):
                return
            self.need(",")

    def body(self) -> None:
        k = self.k
        while not self.take("}"):
            if self.take(";"):
                continue
            self.modifiers()
            if k[self.p] == "{":
                self.p += 1
                self.block()
                continue
            if self.type_declaration():
                continue
            self.type_params()
            self.annotations()
            if k[self.p] in _NAME and k[self.p + 1] == "(":
                self.p += 2
                self.method()
                continue
            if k[self.p] in _NAME and k[self.p + 1] == "{":
                self.p += 2
                self.block()
                continue
            if not self.take("void"):
                self.type()
            self.name()
            if self.take("("):
                self.method()
            else:
                self.variables()
                self.need(";")

    def method(self) -> None:
        self.params()
        self.dims()
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()
        if self.take("default"):
            self.element()
        if self.take("{"):
            self.block()
        else:
            self.need(";")

    def params(self) -> None:
        if self.take(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            self.take("...")
            if self.k[self.p] in _NAME and self.k[self.p + 1] == ".":
                self.p += 2
            if not self.take("this"):
                self.name()
            self.dims()
            if self.take(")"):
                return
            self.need(",")

    def dims(self) -> None:
        k = self.k
        while k[self.p] == "[" and k[self.p + 1] == "]" or k[self.p] == "@":
            if k[self.p] == "@":
                self.annotations()
            else:
                self.p += 2

    def variables(self) -> None:
        """What follows the first name of a declaration of variables."""
        while True:
            self.dims()
            if self.take("="):
                self.value()
            if not self.take(","):
                return
            self.name()

    def value(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                if self.take(","):
                    self.need("}")
                    return
                self.value()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.expr()

    def type(self) -> None:
        k = self.k
        self.annotations()
        if not self.take("t"):
            while True:
                self.name()
                if k[self.p] == "<":
                    self.type_args()
                if k[self.p] != "." or k[self.p + 1] not in _NAME and k[self.p + 1] != "@":
                    break
                self.p += 1
                self.annotations()
        self.dims()

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            self.annotations()
            if self.take("?"):
                if self.take("extends") or self.take("super"):
                    self.type()
            else:
                self.type()
            if self.take(">"):
                return
            self.need(",")

    def expr(self) -> None:
        k = self.k
        while True:
            self.unary()
            while True:
                t = k[self.p]
                if t == "instanceof":
                    self.p += 1
                    self.take("final")
                    self.pattern()
                elif t == ">":
                    self.p += 1
                    while k[self.p] in (">", ">="):
                        self.p += 1
                    break
                elif t in _BINARY:
                    self.p += 1
                    break
                elif t == "?":
                    self.p += 1
                    case, self.case = self.case, False
                    self.expr()
                    self.case = case
                    self.need(":")
                    break
                else:
                    return

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            if not self.take(")"):
                self.pattern()
                while self.take(","):
                    self.pattern()
                self.need(")")
        if self.k[self.p] in _NAME and self.k[self.p] != "when":
            self.p += 1

    def lambda_body(self) -> None:
        if self.take("{"):
            self.block()
        else:
            self.expr()

    def unary(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t in _PREFIX:
                self.p += 1
            elif t == "(":
                end = self.mate(self.p)
                if k[end + 1] == "->" and not self.case:
                    self.p += 1
                    if k[self.p] in _NAME and k[self.p + 1] in (",", ")"):
                        self.name()
                        while self.take(","):
                            self.name()
                        self.need(")")
                    else:
                        self.params()
                    self.p += 1
                    self.lambda_body()
                    return
                if (k[end + 1] in _AFTER_CAST or k[self.p + 1] == "t" and k[end + 1] in _PREFIX) and self.cast(end):
                    continue
                self.p += 1
                case, self.case = self.case, False
                self.expr()
                self.case = case
                self.need(")")
                break
            elif t in _NAME:
                n = k[self.p + 1]
                if n == "->" and not self.case:
                    self.p += 2
                    self.lambda_body()
                    return
                if (n == "<" or n == "[" and k[self.p + 2] == "]" or n == ".") and self.reference():
                    break
                self.p += 1
                break
            elif t == "v" or t == "this" or t == "super":
                self.p += 1
                break
            elif t == "new":
                self.p += 1
                self.creation()
                break
            elif t == "switch":
                self.switch()
                break
            elif t == "t" or t == "void":
                self.p += 1
                self.dims()
                if k[self.p] == "." and k[self.p + 1] == "class":
                    self.p += 2
                elif k[self.p] != "::":
                    raise Bad
                break
            else:
                raise Bad
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                t = k[self.p]
                if t == "new":
                    self.p += 1
                    self.creation()
                elif t == "<":
                    self.type_args()
                    if not self.take("super"):
                        self.name()
                elif t in ("class", "this", "super"):
                    self.p += 1
                else:
                    self.name()
            elif t == "(":
                if k[self.p - 1] not in _NAME and k[self.p - 1] not in ("this", "super"):
                    raise Bad
                self.p += 1
                self.args()
            elif t == "[":
                self.p += 1
                self.expr()
                self.need("]")
            elif t == "++" or t == "--":
                self.p += 1
            elif t == "::":
                self.p += 1
                if k[self.p] == "<":
                    self.type_args()
                if not self.take("new"):
                    self.name()
            else:
                return

    def cast(self, end: int) -> bool:
        """A type and its parentheses in front of a value."""
        at = self.p
        self.p += 1
        try:
            self.type()
            while self.take("&"):
                self.type()
        except Bad:
            self.p = at
            return False
        if self.p != end:
            self.p = at
            return False
        self.p += 1
        return True

    def reference(self) -> bool:
        """A type with arguments or dimensions before :: or .class; names alone are left to the caller."""
        at = self.p
        if at < self.untyped:
            return False
        try:
            self.type()
        except Bad:
            self.untyped = self.p
            self.p = at
            return False
        k = self.k
        if k[self.p] == "::" or k[self.p] == "." and k[self.p + 1] == "class":
            if k[self.p] == ".":
                self.p += 2
            return True
        self.untyped = self.p
        self.p = at
        return False

    def creation(self) -> None:
        k = self.k
        if k[self.p] == "<":
            self.type_args()
        self.annotations()
        if not self.take("t"):
            while True:
                self.name()
                if k[self.p] == "<":
                    self.type_args()
                if not self.take("."):
                    break
        self.annotations()
        if self.take("("):
            self.args()
            if self.take("{"):
                self.body()
            return
        if k[self.p] != "[":
            raise Bad
        if k[self.p + 1] == "]":
            self.dims()
            if k[self.p] != "{":
                raise Bad
            self.value()
            return
        while k[self.p] == "[" and k[self.p + 1] != "]":
            self.p += 1
            self.expr()
            self.need("]")
        self.dims()

    def args(self) -> None:
        if self.take(")"):
            return
        case, self.case = self.case, False
        self.expr()
        while self.take(","):
            self.expr()
        self.case = case
        self.need(")")

    def block(self) -> None:
        case, self.case = self.case, False
        k, known = self.k, _KNOWN
        while k[self.p] != "}":
            short = self.recalled(";", known)
            if short is None:
                continue
            self.stmt()
            if self.p == short[0] + 1 and len(known) < REMEMBERED:
                known.add(short[1])
        self.p += 1
        self.case = case

    def condition(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def declares(self) -> bool:
        """Reads the type and first name of a local variable, if they are there."""
        k, at = self.k, self.p
        if k[at] == "t" or k[at] in _NAME:
            n = k[at + 1]
            if n in ("(", "=", "++", "--", ";", "->", "::"):
                return False
            try:
                self.type()
                if k[self.p] in _NAME and k[self.p + 1] in ("=", ";", ",", ":", "["):
                    self.p += 1
                    return True
            except Bad:
                pass
            self.p = at
        return False

    def local(self) -> bool:
        """A declaration of variables without its end."""
        at = self.p
        self.modifiers()
        if not self.declares():
            if self.p > at:
                raise Bad
            return False
        if self.k[self.p] != ":":
            self.variables()
        return True

    def stmt(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == "{":
            self.p += 1
            self.block()
        elif t == ";":
            self.p += 1
        elif t == "if":
            self.p += 1
            self.headed(self.condition, _HEADS)
            self.stmt()
            if self.take("else"):
                self.stmt()
        elif t == "while" or t == "synchronized":
            self.p += 1
            self.condition()
            self.stmt()
        elif t == "for":
            self.p += 1
            self.need("(")
            if not self.take(";"):
                if self.local():
                    if self.take(":"):
                        self.expr()
                        self.need(")")
                        self.stmt()
                        return
                else:
                    self.exprs()
                self.need(";")
            if not self.take(";"):
                self.expr()
                self.need(";")
            if not self.take(")"):
                self.exprs()
                self.need(")")
            self.stmt()
        elif t == "do":
            self.p += 1
            self.stmt()
            self.need("while")
            self.condition()
            self.need(";")
        elif t == "switch":
            self.switch()
            if k[self.p] == ".":
                self.p -= 1
                raise Bad
        elif t == "try":
            self.p += 1
            resources = self.take("(")
            if resources:
                while not self.take(")"):
                    if not self.local():
                        self.expr()
                    if not self.take(";"):
                        self.need(")")
                        break
            self.need("{")
            self.block()
            n = 0
            while self.take("catch"):
                n += 1
                self.need("(")
                self.modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.name()
                self.need(")")
                self.need("{")
                self.block()
            if self.take("finally"):
                n += 1
                self.need("{")
                self.block()
            if not n and not resources:
                raise Bad
        elif t == "return":
            self.p += 1
            if k[self.p] != ";":
                self.expr()
            self.need(";")
        elif t == "throw":
            self.p += 1
            self.expr()
            self.need(";")
        elif t == "break" or t == "continue":
            self.p += 1
            if k[self.p] in _NAME:
                self.p += 1
            self.need(";")
        elif t == "assert":
            self.p += 1
            self.expr()
            if self.take(":"):
                self.expr()
            self.need(";")
        elif t == "yield" and k[self.p + 1] not in ("=", ".", "(", "++", "--", "["):
            self.p += 1
            self.expr()
            self.need(";")
        elif t in _NAME and k[self.p + 1] == ":":
            self.p += 2
            self.stmt()
        elif t in ("class", "interface", "enum") or t == "record" and k[self.p + 1] in _NAME and k[self.p + 2] in ("(", "<"):
            self.type_declaration()
        elif t in _MODIFIERS or t == "@":
            self.modifiers()
            if k[self.p] == "{" and t == "synchronized" or self.type_declaration():
                return
            if not self.declares():
                raise Bad
            self.variables()
            self.need(";")
        elif self.declares():
            self.variables()
            self.need(";")
        else:
            start = self.p
            self.expr()
            self.need(";")
            # an expression is a statement if it calls, creates, assigns or counts
            if self.p - start == 2:
                raise Bad

    def exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def switch(self) -> None:
        k = self.k
        self.p += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if not self.take("default"):
                self.need("case")
                self.label()
                while self.take(","):
                    if not self.take("default"):
                        self.label()
                if self.take("when"):
                    self.label_expr()
            if self.take("->"):
                if self.take("{"):
                    self.block()
                elif k[self.p] == "throw":
                    self.stmt()
                else:
                    self.expr()
                    self.need(";")
                continue
            self.need(":")
            while k[self.p] not in ("case", "}") and not (k[self.p] == "default" and k[self.p + 1] in (":", "->")):
                self.stmt()

    def label(self) -> None:
        k, at = self.k, self.p
        try:
            self.pattern()
            if k[self.p] in ("->", ":", ",", "when"):
                return
        except Bad:
            pass
        self.p = at
        self.label_expr()

    def label_expr(self) -> None:
        case, self.case = self.case, True
        self.expr()
        self.case = case


JAVA = Grammar(_TOKENS, _kind, _Java)
