"""Rust, macros and attributes as token trees."""

from __future__ import annotations

from quarrylight.llm.grammars.base import LINE, MARKER, REMEMBERED, WORD, Bad, Grammar, Reader

_COMMENT = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
for _ in range(4):  # comments nest
    _COMMENT = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_COMMENT})*+\*/"
_RAW = "|".join(rf'[bc]?r{"#" * n}"(?:[^"]|"(?!{"#" * n}))*+"{"#" * n}' for n in (4, 3, 2, 1)) + r'|[bc]?r"[^"]*"'
_TOKENS = rf"{MARKER}|{_COMMENT}|{LINE}|{_RAW}|[bc]?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\n]|\\(?:x..|u\{{[\da-fA-F_]+\}}|.))'|'{WORD}(?!')|0[xob][\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?(?!\w)|r\#{WORD}|{WORD}|->|=>|::|\.\.\.|\.\.=|\.\.|<<=|&&|\|\||[+\-*/%&|^<>=!]=|<<|\S"
_KEYWORDS = set("use mod fn struct enum impl trait type const static mut let if while for loop match else return break continue where as in pub unsafe async await extern dyn ref move crate super self Self".split())
_RESERVED = set("abstract become box do final macro override priv typeof unsized virtual".split())
_SIGNS = set("( ) [ ] { } , ; . : ? @ # $ ~ = + - * / % & | ^ < > ! -> => :: ... ..= .. && || << == != <= >= += -= *= /= %= &= |= ^= <<=".split())
_BINARY = set("+ - * / % & | ^ < > && || << == != <= >= = += -= *= /= %= &= |= ^= <<=".split())
_PREFIX = {"-", "!", "*", "&", "&&"}
_NAME = {"i", "union", "auto", "default", "macro_rules", "raw", "safe"}
_PATH = _NAME | {"crate", "super", "self", "Self"}
_KNOWN: set[tuple] = set()  # statements that have been read
_HEADS: set[tuple] = set()  # conditions that have been read
_BLOCKS = {"if", "match", "loop", "while", "for", "{", "unsafe"}
_ENDS_EXPR = {")", "]", "}", ",", ";", "=>", "", "else", ":"}


def _kind(token: str) -> str:
    if token in _KEYWORDS or token in _SIGNS:
        return token
    if token in _NAME and token != "i":
        return token
    if token in ("true", "false"):
        return "v"
    c = token[0]
    if token.startswith(("//", "/*")):
        return ""
    if c.isdigit() or token[-1] == '"' and len(token) > 1 or token[-1] == "'" and len(token) > 2 or c in "rbc" and token[-1] == "#" and '"' in token:
        return "v"
    if c == "'" and len(token) > 1:
        return "'"
    return ("reserved" if token in _RESERVED else "i") if c.isidentifier() else "X"


class _Rust(Reader):
    bare = False  # in a condition, where a brace begins its block

    def attempt(self, rule) -> bool:
        bare = self.bare
        if super().attempt(rule):
            return True
        self.bare = bare
        return False

    def name(self) -> None:
        if self.k[self.p] not in _NAME:
            raise Bad
        self.p += 1

    def file(self) -> None:
        k = self.k
        while k[self.p]:
            if not self.item():
                raise Bad

    def attributes(self) -> None:
        k = self.k
        while k[self.p] == "#":
            self.p += 1
            self.take("!")
            if k[self.p] != "[" or k[self.p + 1] == "]":
                raise Bad
            self.tree()

    def visibility(self) -> None:
        if self.take("pub") and self.k[self.p] == "(" and self.k[self.p + 1] in ("crate", "super", "self", "in"):
            self.tree()

    def item(self) -> bool:
        """An item, or nothing if none begins here."""
        k, at = self.k, self.p
        self.attributes()
        if not k[self.p]:
            return self.p > at and k[at + 1] == "!"
        self.visibility()
        t = k[self.p]
        if t == "default" and k[self.p + 1] in ("fn", "impl", "unsafe", "async", "const", "type"):
            self.p += 1
            t = k[self.p]
        if t == "use":
            self.p += 1
            self.use()
            self.need(";")
        elif t == "fn" or self.qualified_fn():
            self.function()
        elif t == "struct" or t == "union" and k[self.p + 1] in _NAME:
            self.p += 1
            self.name()
            self.generics()
            self.where()
            if self.take("("):
                self.tuple_fields()
                self.where()
                self.need(";")
            elif self.take("{"):
                self.fields()
            else:
                self.need(";")
        elif t == "enum":
            self.p += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            self.variants()
        elif t == "impl" or t == "unsafe" and k[self.p + 1] == "impl":
            self.take("unsafe")
            self.p += 1
            if k[self.p] == "<":
                self.generics()
            self.take("const")
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.need("{")
            self.items()
        elif t == "trait" or t in ("unsafe", "auto") and k[self.p + 1] in ("trait", "auto"):
            while k[self.p] != "trait":
                self.p += 1
            self.p += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            if self.take("="):
                self.bounds()
                self.where()
                self.need(";")
                return True
            self.where()
            self.need("{")
            self.items()
        elif t == "type":
            self.p += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
            self.where()
            self.need(";")
        elif t == "const" and (k[self.p + 1] in _NAME) or t == "static" and k[self.p + 1] in (_NAME | {"mut"}):
            self.p += 1
            self.take("mut")
            self.name()
            self.generics()
            self.need(":")
            self.type()
            if self.take("="):
                self.expr()
            self.need(";")
        elif t == "mod" or t == "unsafe" and k[self.p + 1] == "mod":
            self.take("unsafe")
            self.p += 1
            self.name()
            if not self.take(";"):
                self.need("{")
                self.items()
        elif t == "extern" or t == "unsafe" and k[self.p + 1] == "extern":
            self.take("unsafe")
            self.p += 1
            if self.take("crate"):
                if not self.take("self"):
                    self.name()
                if self.take("as"):
                    self.name()
                self.need(";")
            else:
                self.take("v")
                self.need("{")
                self.items()
        elif t == "macro_rules" and k[self.p + 1] == "!":
            self.p += 2
            self.name()
            brace = k[self.p] == "{"
            self.tree()
            if not brace:
                self.need(";")
        elif t in _PATH and self.macro_ahead():
            while k[self.p] != "!":
                self.p += 1
            self.p += 1
            if k[self.p] in _NAME:
                self.p += 1
            brace = k[self.p] == "{"
            self.tree()
            if not brace:
                self.need(";")
        else:
            self.p = at
            return False
        return True

    def macro_ahead(self) -> bool:
        k, at = self.k, self.p + 1
        while k[at] == "::" and k[at + 1] in _PATH:
            at += 2
        return k[at] == "!" and (k[at + 1] in ("(", "[", "{") or k[at + 1] in _NAME and k[at + 2] in ("(", "{"))

    def qualified_fn(self) -> bool:
        k, at = self.k, self.p
        while k[at] in ("const", "async", "unsafe", "extern", "safe"):
            at += 1
            if k[at - 1] == "extern" and k[at] == "v":
                at += 1
        return at > self.p and k[at] == "fn"

    def items(self) -> None:
        k = self.k
        while not self.take("}"):
            if k[self.p] == "#" and k[self.p + 1] == "!":
                self.attributes()
            elif not self.item():
                raise Bad

    def use(self) -> None:
        k = self.k
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                while not self.take("}"):
                    self.use()
                    if not self.take(","):
                        self.need("}")
                        return
                return
            if k[self.p] not in _PATH:
                raise Bad
            self.p += 1
            if not self.take("::"):
                break
        if self.take("as"):
            self.name()

    def function(self) -> None:
        k = self.k
        while k[self.p] != "fn":
            self.p += 1
        self.p += 1
        self.name()
        self.generics()
        self.need("(")
        while not self.take(")"):
            self.attributes()
            if self.take("..."):
                self.need(")")
                break
            at = self.p
            while k[self.p] in ("&", "'", "mut"):
                self.p += 1
            if self.take("self"):
                if self.take(":"):
                    self.type()
            else:
                self.p = at
                self.pattern()
                self.need(":")
                if not self.take("..."):
                    self.type()
            if not self.take(","):
                self.need(")")
                break
        if self.take("->"):
            self.type()
        self.where()
        if self.take("{"):
            self.block()
        else:
            self.need(";")

    def generics(self) -> None:
        """The parameters of a definition."""
        if not self.take("<"):
            return
        while not self.take(">"):
            self.attributes()
            if self.take("'"):
                if self.take(":"):
                    self.bounds()
            elif self.take("const"):
                self.name()
                self.need(":")
                self.type()
                if self.take("="):
                    self.generic_arg()
            else:
                self.name()
                if self.take(":"):
                    self.bounds()
                if self.take("="):
                    self.type()
            if not self.take(","):
                self.shift_split()
                self.need(">")
                return

    def shift_split(self) -> None:
        """A >= that closes type arguments before an assignment."""
        if self.k[self.p] == ">=":
            self.k[self.p : self.p + 1] = [">", "="]
            self._mates = None

    def bounds(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t == "'":
                self.p += 1
            elif t == "(":
                self.p += 1
                self.bounds()
                self.need(")")
            elif t in _PATH or t in ("?", "for", "::", "~", "<", "async", "const", "use", "!"):
                if t == "use":
                    self.p += 1
                    self.generics()
                else:
                    while k[self.p] in ("?", "~", "const", "async", "!"):
                        self.p += 1
                    self.for_lifetimes()
                    self.type_path()
            else:
                return
            if not self.take("+"):
                return

    def for_lifetimes(self) -> None:
        if self.k[self.p] == "for" and self.k[self.p + 1] == "<":
            self.p += 1
            self.generics()

    def where(self) -> None:
        if not self.take("where"):
            return
        k = self.k
        while k[self.p] not in ("{", ";", "="):
            if not self.take("'"):
                self.for_lifetimes()
                self.type()
            self.need(":")
            self.bounds()
            if not self.take(","):
                return

    def tuple_fields(self) -> None:
        while not self.take(")"):
            self.attributes()
            self.visibility()
            self.type()
            if not self.take(","):
                self.need(")")
                return

    def fields(self) -> None:
        while not self.take("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if self.take("="):
                self.expr()
            if not self.take(","):
                self.need("}")
                return

    def variants(self) -> None:
        while not self.take("}"):
            self.attributes()
            self.visibility()
            self.name()
            if self.take("("):
                self.tuple_fields()
            elif self.take("{"):
                self.fields()
            if self.take("="):
                self.expr()
            if not self.take(","):
                self.need("}")
                return

    def type(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t == "&" or t == "&&":
                self.p += 1
                self.take("'")
                self.take("mut")
            elif t == "*":
                self.p += 1
                if k[self.p] not in ("const", "mut"):
                    raise Bad
                self.p += 1
            else:
                break
        if t == "(":
            self.p += 1
            while not self.take(")"):
                self.type()
                if not self.take(","):
                    self.need(")")
                    break
        elif t == "[":
            self.p += 1
            self.type()
            if self.take(";"):
                self.within(self.expr)
            self.need("]")
        elif t == "!":
            self.p += 1
        elif t == "dyn" or t == "impl":
            self.p += 1
            self.bounds()
            return
        elif t in ("fn", "unsafe", "extern", "for"):
            self.for_lifetimes()
            while k[self.p] in ("unsafe", "extern", "v"):
                self.p += 1
            if not self.take("fn"):
                self.type_path()
                return
            self.need("(")
            while not self.take(")"):
                self.attributes()
                if self.take("..."):
                    self.need(")")
                    break
                if k[self.p] in _NAME and k[self.p + 1] == ":":
                    self.p += 2
                self.type()
                if not self.take(","):
                    self.need(")")
                    break
            if self.take("->"):
                self.type()
        else:
            self.type_path()
            if k[self.p] == "!" and k[self.p + 1] in ("(", "[", "{"):
                self.p += 1
                self.tree()

    def type_path(self) -> None:
        k = self.k
        if k[self.p] in ("<", "<<"):
            self.qualified_self()
        else:
            self.take("::")
            if k[self.p] not in _PATH:
                raise Bad
            self.p += 1
            self.path_args()
        while k[self.p] == "::" and (k[self.p + 1] in _PATH):
            self.p += 2
            self.path_args()

    def qualified_self(self) -> None:
        self.split_shift()
        self.need("<")
        self.type()
        if self.take("as"):
            self.type_path()
        self.shift_split()
        self.need(">")

    def path_args(self) -> None:
        k = self.k
        if k[self.p] == "::" and k[self.p + 1] in ("<", "<<", "("):
            self.p += 1
        if k[self.p] in ("<", "<<"):
            self.generic_args()
        elif k[self.p] == "(":
            self.p += 1
            while not self.take(")"):
                self.type()
                if not self.take(","):
                    self.need(")")
                    break
            if self.take("->"):
                self.type()

    def split_shift(self) -> None:
        """A << that opens two brackets."""
        if self.k[self.p] == "<<":
            self.k[self.p : self.p + 1] = ["<", "<"]
            self._mates = None

    def generic_args(self) -> None:
        self.split_shift()
        self.need("<")
        while not self.take(">"):
            self.generic_arg()
            if not self.take(","):
                self.shift_split()
                self.need(">")
                return

    def generic_arg(self) -> None:
        k = self.k
        t = k[self.p]
        if t == "'":
            self.p += 1
        elif t == "v":
            self.p += 1
        elif t == "-":
            self.p += 1
            self.need("v")
        elif t == "{":
            self.p += 1
            self.within(self.block)
        elif t in _NAME and k[self.p + 1] in ("=", ":"):
            self.p += 2
            if k[self.p - 1] == ":":
                self.bounds()
            elif k[self.p] in ("v", "{", "-"):
                self.generic_arg()
            else:
                self.type()
        else:
            self.type()
            if self.take("="):
                self.type()
            elif self.take(":"):
                self.bounds()

    def pattern(self) -> None:
        self.take("|")
        while True:
            self.one_pattern()
            if not self.take("|"):
                return

    def one_pattern(self) -> None:
        k = self.k
        while k[self.p] in ("&", "&&"):
            self.p += 1
            self.take("mut")
        t = k[self.p]
        if t == "(" or t == "[":
            close = ")" if t == "(" else "]"
            self.p += 1
            while not self.take(close):
                self.attributes()
                self.pattern()
                if not self.take(","):
                    self.need(close)
                    break
            return
        if t == ".." or t == "..=":
            self.p += 1
            if k[self.p] in ("v", "-") or k[self.p] in _PATH:
                self.bound()
            return
        if t == "v" or t == "-" or t == "const" and k[self.p + 1] == "{":
            self.bound()
        elif t == "ref" or t == "mut":
            while k[self.p] in ("ref", "mut"):
                self.p += 1
            self.name()
            if self.take("@"):
                self.one_pattern()
            return
        else:
            self.expr_path()
            t = k[self.p]
            if t == "!" and k[self.p + 1] in ("(", "[", "{"):
                self.p += 1
                self.tree()
                return
            if t == "(":
                self.p += 1
                while not self.take(")"):
                    self.attributes()
                    self.pattern()
                    if not self.take(","):
                        self.need(")")
                        break
                return
            if t == "{":
                self.p += 1
                while not self.take("}"):
                    self.attributes()
                    if self.take(".."):
                        self.need("}")
                        return
                    while k[self.p] in ("ref", "mut"):
                        self.p += 1
                    if k[self.p] not in _NAME and k[self.p] != "v":
                        raise Bad
                    self.p += 1
                    if self.take(":"):
                        self.pattern()
                    if not self.take(","):
                        self.need("}")
                        return
                return
            if t == "@":
                self.p += 1
                self.one_pattern()
                return
        if k[self.p] in ("..", "..=", "..."):
            self.p += 1
            if k[self.p] in ("v", "-") or k[self.p] in _PATH:
                self.bound()

    def bound(self) -> None:
        k = self.k
        if self.take("const"):
            self.need("{")
            self.within(self.block)
            return
        self.take("-")
        if self.take("v"):
            return
        self.expr_path()

    def expr_path(self) -> None:
        k = self.k
        if k[self.p] in ("<", "<<"):
            self.qualified_self()
        else:
            self.take("::")
            if k[self.p] not in _PATH:
                raise Bad
            self.p += 1
        while k[self.p] == "::":
            self.p += 1
            if k[self.p] in ("<", "<<"):
                self.generic_args()
            elif k[self.p] in _PATH:
                self.p += 1
            else:
                raise Bad

    def within(self, rule) -> None:
        bare, self.bare = self.bare, False
        rule()
        self.bare = bare

    def block(self) -> None:
        """The rest of a block after its brace."""
        k = self.k
        bare, self.bare = self.bare, False
        known = _KNOWN
        short = (-1, ())
        while True:
            if self.p == short[0] + 1 and len(known) < REMEMBERED:
                known.add(short[1])
            if self.take("}"):
                break
            if self.take(";"):
                continue
            short = self.recalled(";", known)
            if short is None:
                short = (-1, ())
                continue
            if k[self.p] == "#" and k[self.p + 1] == "!":
                self.attributes()
                continue
            t = k[self.p]
            if t == "let":
                self.let()
                continue
            if t not in ("i", "v", "(", "*", "&", "self", "{", "if", "for", "match", "return") and self.item_first():
                continue
            self.attributes()
            t = k[self.p]
            if t == "let":
                self.let()
                continue
            if t == "'" and k[self.p + 1] == ":":
                self.p += 2
                t = k[self.p]
            if t in _BLOCKS and not (t == "unsafe" and k[self.p + 1] != "{") or t in ("async", "const") and (k[self.p + 1] == "{" or k[self.p + 1] == "move" and k[self.p + 2] == "{"):
                self.primary()
                if k[self.p] in (".", "?"):
                    self.postfix()
                    self.rest()
                    if not self.take(";") and k[self.p] != "}":
                        raise Bad
                else:
                    self.take(";")
                continue
            macro = t in _PATH and k[self.p + 1] == "!" and k[self.p + 2] == "{" or t in _PATH and k[self.p + 1] == "::" and self.macro_ahead()
            self.expr()
            if self.take(";") or k[self.p] == "}" or macro and k[self.p - 1] == "}":
                continue
            raise Bad
        self.bare = bare

    def item_first(self) -> bool:
        """An item, unless it begins like an expression."""
        k, at = self.k, self.p
        t = k[at]
        if t == "#":
            while k[at] == "#":
                at = self.mate(at + 1) + 1
            t = k[at]
        if t in ("use", "fn", "struct", "enum", "impl", "trait", "type", "static", "mod", "extern", "pub") and not (t == "static" and k[at + 1] in ("|", "||", "move")):
            return self.item()
        if t == "const":
            return k[at + 1] not in ("{", "|", "||", "move", "async") and self.item()
        if t in ("unsafe", "async"):
            return k[at + 1] in ("fn", "impl", "trait", "extern", "unsafe", "mod") and self.item()
        if t == "macro_rules" and k[at + 1] == "!" or t == "union" and k[at + 1] in _NAME and k[at + 2] in ("{", "<"):
            return self.item()
        return False

    def let(self) -> None:
        self.need("let")
        self.pattern()
        if self.take(":"):
            self.type()
        if self.take("="):
            self.expr()
            if self.take("else"):
                self.need("{")
                self.block()
        self.need(";")

    def expr(self) -> None:
        self.unary()
        self.rest()

    def rest(self) -> None:
        """What follows an operand."""
        k = self.k
        while True:
            t = k[self.p]
            if t == "as":
                self.p += 1
                self.type()
            elif t == ">":
                self.p += 1
                while k[self.p] in (">", ">="):
                    self.p += 1
                self.unary()
            elif t in _BINARY:
                self.p += 1
                self.unary()
            elif t == ".." or t == "..=":
                self.p += 1
                if k[self.p] not in _ENDS_EXPR and not (self.bare and k[self.p] == "{"):
                    self.unary()
            else:
                return

    def unary(self) -> None:
        k = self.k
        while k[self.p] in _PREFIX:
            t = k[self.p]
            self.p += 1
            if t == "&" or t == "&&":
                if k[self.p] == "raw" and k[self.p + 1] in ("const", "mut"):
                    self.p += 2
                self.take("mut")
        if k[self.p] == "#":
            self.attributes()
        self.primary()
        self.postfix()

    def postfix(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                if k[self.p] in _NAME:
                    self.p += 1
                    if k[self.p] == "::":
                        self.p += 1
                        self.generic_args()
                elif k[self.p] in ("v", "await"):
                    self.p += 1
                else:
                    raise Bad
            elif t == "?":
                self.p += 1
            elif t == "(":
                self.p += 1
                self.listed(")")
            elif t == "[":
                self.p += 1
                self.within(self.expr)
                self.need("]")
            else:
                return

    def listed(self, close: str) -> None:
        bare, self.bare = self.bare, False
        while not self.take(close):
            self.attributes()
            self.expr()
            if not self.take(","):
                self.need(close)
                break
        self.bare = bare

    def condition(self) -> None:
        bare, self.bare = self.bare, True
        self.headed(self.expr, _HEADS)
        self.bare = bare

    def primary(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == "v":
            self.p += 1
        elif t in _PATH or t in ("::", "<", "<<"):
            self.expr_path()
            n = k[self.p]
            if n == "!" and k[self.p + 1] in ("(", "[", "{"):
                self.p += 1
                self.tree()
            elif n == "{" and not self.bare and t != "self":
                self.p += 1
                self.inits()
        elif t == "(":
            self.p += 1
            self.listed(")")
        elif t == "[":
            self.p += 1
            if self.take("]"):
                return
            bare, self.bare = self.bare, False
            self.attributes()
            self.expr()
            if self.take(";"):
                self.expr()
                self.need("]")
            elif self.take(","):
                self.listed("]")
            else:
                self.need("]")
            self.bare = bare
        elif t == "{":
            self.p += 1
            self.block()
        elif t == "if":
            while True:
                self.p += 1
                self.condition()
                self.need("{")
                self.block()
                if not self.take("else"):
                    return
                if k[self.p] != "if":
                    self.need("{")
                    self.block()
                    return
        elif t == "let":
            self.p += 1
            self.pattern()
            self.need("=")
            self.unary()
        elif t == "match":
            self.p += 1
            self.condition()
            self.need("{")
            bare, self.bare = self.bare, False
            self.arms()
            self.bare = bare
        elif t == "while":
            self.p += 1
            self.condition()
            self.need("{")
            self.block()
        elif t == "loop":
            self.p += 1
            self.need("{")
            self.block()
        elif t == "for" and k[self.p + 1] != "<":
            self.p += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.need("{")
            self.block()
        elif t == "unsafe" or t == "const" and k[self.p + 1] == "{":
            self.p += 1
            self.need("{")
            self.block()
        elif t == "'":
            self.p += 1
            self.need(":")
            self.primary()
        elif t in ("|", "||", "move", "static", "async", "for"):
            self.for_lifetimes()
            while k[self.p] in ("static", "async", "move"):
                self.p += 1
            if k[self.p] == "{" and t in ("async",):
                self.p += 1
                self.block()
                return
            self.closure()
        elif t == "return" or t == "break":
            self.p += 1
            if t == "break" and k[self.p] == "'":
                self.p += 1
            if k[self.p] not in _ENDS_EXPR and not (self.bare and k[self.p] == "{") and k[self.p] not in (".", "?"):
                self.expr()
        elif t == "continue":
            self.p += 1
            self.take("'")
        elif t == ".." or t == "..=":
            self.p += 1
            if k[self.p] not in _ENDS_EXPR and not (self.bare and k[self.p] == "{"):
                self.unary()
        else:
            raise Bad

    def closure(self) -> None:
        k = self.k
        if not self.take("||"):
            self.need("|")
            while not self.take("|"):
                self.attributes()
                self.one_pattern()
                if self.take(":"):
                    self.type()
                if not self.take(","):
                    self.need("|")
                    break
        if self.take("->"):
            self.type()
            self.need("{")
            self.block()
        else:
            self.expr()

    def inits(self) -> None:
        k = self.k
        bare, self.bare = self.bare, False
        while not self.take("}"):
            self.attributes()
            if self.take(".."):
                if k[self.p] != "}":
                    self.expr()
                self.need("}")
                break
            if k[self.p] not in _NAME and k[self.p] != "v":
                raise Bad
            self.p += 1
            if self.take(":"):
                self.expr()
            if not self.take(","):
                self.need("}")
                break
        self.bare = bare

    def arms(self) -> None:
        k = self.k
        while not self.take("}"):
            self.attributes()
            self.pattern()
            if self.take("if"):
                self.expr()
            self.need("=>")
            block = k[self.p] == "{"
            if block:
                self.p += 1
                self.block()
                if k[self.p] in (".", "?"):
                    self.postfix()
                    self.rest()
                    block = False
            else:
                block = k[self.p] in _BLOCKS and k[self.p] != "{"
                self.expr()
                block = block and k[self.p - 1] == "}"
            if not self.take(",") and not block:
                self.need("}")
                return


class _RustGrammar(Grammar):
    def bare(self, text: str) -> str:
        if text.startswith("#!") and not text.startswith("#!["):
            return text[text.find("\n") + 1 :] if "\n" in text else ""
        return text


RUST = _RustGrammar(_TOKENS, _kind, _Rust)
