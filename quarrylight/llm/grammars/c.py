"""C, with the preprocessor's lines taken out and what compilers add in common use: attributes, asm, statement expressions.

Of conditional sections the first branch counts, or else the last. A name in capitals may be a macro: alone or with
arguments it can stand among the specifiers of a declaration and in place of a statement.
"""

from __future__ import annotations

import re

from quarrylight.llm.grammars.base import BLOCK, END, LINE, MARKER, REMEMBERED, STRING, WORD, Bad, Grammar, Reader

_TOKENS = rf"{MARKER}|{BLOCK}|{LINE}|^[ \t]*\#(?:\\\r?\n|/\*(?:[^*]|\*(?!/))*+\*/|[^\n])*|(?:L|u8?|U)?{STRING}|(?:L|u8?|U)?'(?:[^'\\\n]|\\.)+'|\.?\d(?:[eEpP][+-]|[\w.'])*|{WORD}|->|\.\.\.|<<=|>>=|\+\+|--|&&|\|\||[+\-*/%&|^<>=!]=|<<|>>|\\\r?\n|\S"
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[uUlLfFzZ]*")
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)[ \t]*(.*)", re.S)
_DIRECTIVES = {"include", "define", "ifdef", "ifndef", "undef", "if", "elif", "elifdef", "elifndef", "else", "endif", "pragma", "error", "warning", "line", "include_next", "import", "ident", ""}

_WORDS = {w: "t" for w in "int char long short unsigned signed float double void _Bool _Complex __int128 __signed__".split()}
_WORDS |= {w: "q" for w in "const static extern inline volatile register restrict auto typedef _Noreturn _Thread_local __thread _Atomic __inline __inline__ __restrict __restrict__ __const __volatile__ __extension__ __cdecl __stdcall constexpr thread_local".split()}
_WORDS |= {w: "attr" for w in "__attribute__ __attribute __declspec _Alignas alignas".split()}
_WORDS |= {w: "typeof" for w in "typeof __typeof__ __typeof typeof_unqual".split()}
_WORDS |= {w: "asm" for w in "asm __asm__ __asm".split()}
_WORDS |= {w: "sizeof" for w in "sizeof _Alignof alignof __alignof__ __alignof".split()}
_WORDS |= {w: w for w in "struct enum if else while for do switch case default return break continue goto _Generic".split()} | {"union": "struct", "_Static_assert": "assert", "static_assert": "assert"}
_SIGNS = set("( ) [ ] { } , ; . : ? = + - * / % & | ^ < > ! ~ -> ... ++ -- && || << >> == != <= >= += -= *= /= %= &= |= ^= <<= >>=".split())
_BINARY = set("+ - * / % & | ^ < > && || << >> == != <= >= = += -= *= /= %= &= |= ^= <<= >>=".split())
_PREFIX = set("+ - * & ! ~ ++ -- &&".split())
_TYPE_START = {"t", "q", "struct", "enum", "typeof", "attr"}
_NAME = {"i", "M"}
_KNOWN: set[tuple] = set()  # statements that have been read
_HEADS: set[tuple] = set()  # conditions that have been read


def _kind(token: str) -> str:
    if token in _WORDS:
        return _WORDS[token]
    if token in _SIGNS:
        return token
    c = token[0]
    if token.startswith(("//", "/*")) or c == "\\" and len(token) > 1:
        return ""
    if c != "#" and not c.isspace():
        if token[-1] == '"' and len(token) > 1:
            return "s"
        if token[-1] == "'" and len(token) > 1:
            return "v"
    if c.isdigit() or c == "." and len(token) > 1:
        return "v" if _NUMBER.fullmatch(token.replace("'", "")) else "X"
    if c.isidentifier():
        return "M" if token.isupper() and len(token) > 1 else "i"
    if c.isspace() or c == "#" and len(token) > 1:
        m = _DIRECTIVE.match(token)
        if not m or m[1] not in _DIRECTIVES:
            return "X"
        if m[1] in ("include", "include_next"):
            return "" if re.match(r'["<\w]', m[2]) else "X"
        if m[1] in ("define", "ifdef", "ifndef", "undef", "if", "elif") and not m[2].strip():
            return "X"
        if m[1] in ("if", "ifdef", "ifndef"):
            return "#if0" if re.match(r"(?:defined\s*\(?\s*)?__cplusplus|0\b", m[2]) and m[1] != "ifndef" else "#if"
        return "#else" if m[1] in ("else", "elif", "elifdef", "elifndef") else "#endif" if m[1] == "endif" else ""
    return "X"


class _C(Reader):
    def file(self) -> None:
        k = self.k
        while k[self.p]:
            self.external()

    def external(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == ";":
            self.p += 1
        elif t == "asm" or t == "assert":
            self.p += 1
            while k[self.p] == "q":
                self.p += 1
            self.tree()
            self.take(";")
        elif t == "M" and k[self.p + 1] == "(":
            end = self.mate(self.p + 1)
            after = k[end + 1]
            if after in _TYPE_START or after in _NAME and k[end + 2] != ";" or after in ("", ";", "}"):
                self.p = end + 1
                self.take(";")
            else:
                self.declaration(True)
        elif t == "M" and (k[self.p + 1] in _TYPE_START or k[self.p + 1] == "M" and k[self.p + 2] in (_TYPE_START | {"M"})):
            self.p += 1
        else:
            self.declaration(True)

    def specifiers(self, abstract: bool = False) -> bool:
        """The specifiers of a declaration; whether there are any."""
        k, start, typed = self.k, self.p, False
        while True:
            t = k[self.p]
            if t == "t":
                typed = True
                self.p += 1
            elif t == "q":
                self.p += 1
            elif t == "attr":
                self.p += 1
                self.tree()
            elif t == "typeof":
                self.p += 1
                self.tree()
                typed = True
            elif t == "struct" or t == "enum":
                self.p += 1
                self.attributes()
                named = k[self.p] in _NAME
                self.p += named
                while k[self.p] in _NAME and k[self.p + 1] == "{":
                    self.p += 1
                if k[self.p] == "{":
                    self.p += 1
                    (self.fields if t == "struct" else self.enumerators)()
                    self.attributes()
                elif not named:
                    raise Bad
                typed = True
            elif t in _NAME:
                n = k[self.p + 1]
                if typed:
                    if t == "M" and (n in _NAME or n in _TYPE_START or n == "*"):
                        self.p += 1
                        continue
                    if t == "M" and n == "(":
                        end = self.mate(self.p + 1)
                        if k[end + 1] in _NAME or k[end + 1] == "*":
                            self.p = end + 1
                            continue
                    return True
                if n in _NAME or n in _TYPE_START or n == "*" or abstract and n in (")", ",", "[", "...", ":"):
                    self.p += 1
                    # what is in capitals may be a macro before the type
                    typed = t == "i" or n in _NAME and k[self.p + 1] not in _NAME and k[self.p + 1] not in ("*", "q")
                elif n == "(" and t == "M" and self.between(self.mate(self.p + 1) + 1):
                    self.p = self.mate(self.p + 1) + 1
                elif abstract and n == "(":
                    self.p += 1
                    typed = True
                elif abstract and n == ";":
                    self.p += 1
                    typed = True
                else:
                    return self.p > start
            else:
                return self.p > start

    def between(self, at: int) -> bool:
        """Whether a place can follow a macro among the specifiers."""
        t = self.k[at]
        return t in _NAME or t in _TYPE_START or t == "*" or t == ")"

    def attributes(self) -> None:
        while self.k[self.p] in ("attr", "asm"):
            self.p += 1
            self.tree()

    def fields(self) -> None:
        k = self.k
        while not self.take("}"):
            t = k[self.p]
            if t == ";":
                self.p += 1
            elif t == "assert":
                self.p += 1
                self.tree()
                self.need(";")
            elif t == "M" and k[self.p + 1] == "(" and k[self.mate(self.p + 1) + 1] in (";", "}"):
                self.p = self.mate(self.p + 1) + 1
                self.take(";")
            elif t == "M" and k[self.p + 1] in (_TYPE_START | {";"}):
                self.p += 1
            else:
                self.declaration(False, True)

    def enumerators(self) -> None:
        while not self.take("}"):
            if self.k[self.p] not in _NAME:
                raise Bad
            self.p += 1
            self.attributes()
            if self.take("="):
                self.expr()
            if not self.take(","):
                self.need("}")
                return

    def declaration(self, top: bool, field: bool = False) -> None:
        k = self.k
        there = self.specifiers(field)
        if there and self.take(";"):
            return
        if top and k[self.p] in _NAME and k[self.p + 1] == "(" and k[self.mate(self.p + 1) + 1] == "=":
            self.p = self.mate(self.p + 1) + 2  # a macro that declares what is set
            self.initializer()
            self.need(";")
            return
        if not there and not (top and k[self.p] in _NAME and k[self.p + 1] == "("):
            raise Bad
        first = True
        while True:
            function = False
            if not (field and k[self.p] == ":"):
                function = self.declarator(False)
            while k[self.p] in ("attr", "asm") or k[self.p] == "M" and k[self.p + 1] in (";", "=", ",", "{", "M", "("):
                self.p += 1
                if k[self.p] == "(":
                    self.tree()
            if function and first and top:
                if k[self.p] == "{":
                    self.p += 1
                    self.block()
                    return
                while k[self.p] in _TYPE_START or k[self.p] in _NAME:  # parameters declared the old way
                    self.declaration(False)
                    if k[self.p] == "{":
                        self.p += 1
                        self.block()
                        return
            if not there:
                raise Bad
            if field and self.take(":"):
                self.expr()
                self.attributes()
            if self.take("="):
                self.initializer()
            if self.take(","):
                first = False
                continue
            self.need(";")
            return

    def declarator(self, abstract: bool) -> bool:
        """A declarator; whether it ends as that of a function."""
        k = self.k
        while k[self.p] in ("*", "q", "attr", "^"):
            self.p += 1
            if k[self.p - 1] == "attr":
                self.tree()
        t = k[self.p]
        if t == "M" and k[self.p + 1] in ("i", "*"):
            self.p += 1
            return self.declarator(abstract)
        if t in _NAME:
            self.p += 1
        elif t == "(" and (not abstract or k[self.p + 1] in ("*", "^", "(", "attr") or k[self.p + 1] in _NAME and k[self.p + 2] in (")", "(", "[", "*") and k[self.mate(self.p) + 1] in ("(", "[")):
            self.p += 1
            self.declarator(abstract)
            self.need(")")
        elif not abstract:
            raise Bad
        function = False
        while True:
            t = k[self.p]
            if t == "(":
                self.p += 1
                self.params()
                function = True
            elif t == "[":
                self.p += 1
                while k[self.p] == "q":
                    self.p += 1
                if k[self.p] == "*" and k[self.p + 1] == "]":
                    self.p += 1
                elif k[self.p] != "]":
                    self.expr()
                self.need("]")
                function = False
            else:
                return function

    def params(self) -> None:
        if self.take(")"):
            return
        while True:
            if self.take("..."):
                self.need(")")
                return
            if not self.specifiers(True):
                raise Bad
            self.declarator(True)
            while self.k[self.p] in ("attr", "M"):
                self.p += 1
                if self.k[self.p] == "(":
                    self.tree()
            if self.take(")"):
                return
            self.need(",")

    def type_name(self) -> None:
        if not self.specifiers(True):
            raise Bad
        self.declarator(True)

    def initializer(self) -> None:
        if self.k[self.p] == "{":
            self.p += 1
            self.values()
        else:
            self.expr()

    def values(self) -> None:
        k = self.k
        while not self.take("}"):
            if k[self.p] in _NAME and k[self.p + 1] == ":":
                self.p += 2
            designated = False
            while k[self.p] in (".", "["):
                designated = True
                if self.take("."):
                    if k[self.p] not in _NAME:
                        raise Bad
                    self.p += 1
                else:
                    self.p += 1
                    self.expr()
                    if self.take("..."):
                        self.expr()
                    self.need("]")
            if designated:
                self.take("=")
            self.initializer()
            if not self.take(","):
                if k[self.p] == "M" or k[self.p - 1] == ")" and k[self.p] in _NAME:
                    continue  # macros that bring their own commas
                self.need("}")
                return

    def exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def expr(self) -> None:
        k = self.k
        while True:
            self.unary()
            t = k[self.p]
            if t in _BINARY:
                self.p += 1
            elif t == "?":
                self.p += 1
                if k[self.p] != ":":
                    self.exprs()
                self.need(":")
            else:
                return

    def unary(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t in _PREFIX:
                self.p += 1
            elif t == "sizeof":
                self.p += 1
                if k[self.p] == "(" and self.typed(self.p + 1):
                    self.p += 1
                    self.type_name()
                    self.need(")")
                    if k[self.p] != "{":
                        return
                    self.p += 1
                    self.values()
                    break
            elif t == "(":
                if k[self.p + 1] == "{":
                    self.p += 2
                    self.block()
                    self.need(")")
                    break
                if self.typed(self.p + 1):
                    self.p += 1
                    self.type_name()
                    self.need(")")
                    if k[self.p] == "{":
                        self.p += 1
                        self.values()
                        break
                    continue
                if k[self.p + 1] in _NAME and k[self.p + 2] == ")" and k[self.p + 3] == "(" and k[self.mate(self.p + 3) + 1] in ("i", "M", "v", "s", "(", "sizeof", "~", "!"):
                    self.p += 3
                    continue  # a cast of a cast
                self.p += 1
                self.exprs()
                self.need(")")
                if k[self.p] in ("i", "M", "v", "s", "sizeof", "~", "!"):
                    if k[self.p - 2] not in _NAME:
                        raise Bad
                    continue  # a cast to a named type
                break
            elif t in _NAME or t == "s":
                self.p += 1
                while k[self.p] == "s" or t == "s" and k[self.p] in _NAME or t == "M" and k[self.p] == "M":
                    self.p += 1
                break
            elif t == "v":
                self.p += 1
                break
            elif t == "_Generic":
                self.p += 1
                self.tree()
                break
            elif t == "q" and k[self.p + 1] in ("(", "i"):
                self.p += 1  # __extension__
            else:
                raise Bad
        while True:
            t = k[self.p]
            if t == "(":
                self.p += 1
                self.args()
            elif t == "." or t == "->":
                if k[self.p + 1] not in _NAME:
                    raise Bad
                self.p += 2
            elif t == "[":
                self.p += 1
                self.exprs()
                self.need("]")
            elif t == "++" or t == "--":
                self.p += 1
            else:
                return

    def typed(self, at: int) -> bool:
        """Whether a type, not an expression, begins at a place after a parenthesis."""
        k = self.k
        t = k[at]
        if t in _TYPE_START:
            return True
        if t not in _NAME:
            return False
        n = k[at + 1]
        if t == "M" and n == "(" and k[self.mate(at + 1) + 1] == "*" and k[self.mate(at + 1) + 2] in (")", "*", ","):
            return True
        if n == "*":
            while k[at + 1] in ("*", "q"):
                at += 1
            return k[at + 1] in (")", ",", "[") or k[at + 1] == "(" and k[at + 2] == "*"
        if n == "(" and k[at + 2] == "*" and k[at + 3] == ")" or n == "[" and k[at + 2] == "]" or n == "q":
            return True
        return n == ")" and k[at + 2] == "{"

    def args(self) -> None:
        k = self.k
        if self.take(")"):
            return
        while True:
            if self.typed(self.p):
                self.type_name()
            elif k[self.p] == "{":
                self.p += 1
                self.values()
            elif k[self.p] in _BINARY and k[self.p + 1] in (",", ")"):
                self.p += 1  # an operator as argument of a macro
            elif k[self.p] not in (",", ")"):
                self.expr()
            if self.take(")"):
                return
            self.need(",")

    def block(self) -> None:
        k, known = self.k, _KNOWN
        while k[self.p] != "}":
            short = self.recalled(";", known)
            if short is None:
                continue
            self.stmt()
            if self.p == short[0] + 1 and len(known) < REMEMBERED:
                known.add(short[1])
        self.p += 1

    def stmt(self) -> None:
        k, t = self.k, self.k[self.p]
        if t == "{":
            self.p += 1
            self.block()
        elif t == ";":
            self.p += 1
        elif t == "if" or t == "while" or t == "switch":
            self.p += 1
            self.headed(self.condition, _HEADS)
            self.stmt()
            if t == "if" and self.take("else"):
                self.stmt()
        elif t == "for":
            self.p += 1
            self.need("(")
            if not self.take(";"):
                if self.declares():
                    self.declaration(False)
                else:
                    self.exprs()
                    self.need(";")
            if not self.take(";"):
                self.exprs()
                self.need(";")
            if not self.take(")"):
                self.exprs()
                self.need(")")
            self.stmt()
        elif t == "do":
            self.p += 1
            self.stmt()
            self.need("while")
            self.need("(")
            self.exprs()
            self.need(")")
            self.need(";")
        elif t == "return":
            self.p += 1
            if k[self.p] == "{":
                raise Bad
            if k[self.p] != ";":
                self.exprs()
            self.need(";")
        elif t == "break" or t == "continue":
            self.p += 1
            self.need(";")
        elif t == "goto":
            self.p += 1
            self.expr()
            self.need(";")
        elif t == "case":
            self.p += 1
            self.expr()
            if self.take("..."):
                self.expr()
            self.need(":")
            if k[self.p] != "}":
                self.stmt()
        elif t == "default":
            self.p += 1
            self.need(":")
            if k[self.p] != "}":
                self.stmt()
        elif t == "asm" or t == "assert":
            self.p += 1
            while k[self.p] in ("q", "goto"):
                self.p += 1
            self.tree()
            self.need(";")
        elif t in _NAME and k[self.p + 1] == ":":
            self.p += 2
            while k[self.p] == "attr":
                self.p += 1
                self.tree()
                self.take(";")
            if k[self.p] != "}":
                self.stmt()
        elif self.declares():
            self.declaration(True)
        else:
            at = self.p
            self.exprs()
            if self.take(";"):
                return
            if k[at] == "M" and (self.p == at + 1 or k[at + 1] == "(" and self.mate(at + 1) == self.p - 1):
                if k[self.p] == "{":
                    self.stmt()
                return  # a macro that needs no semicolon or heads a block
            if k[at] == "i" and k[at + 1] == "(" and self.mate(at + 1) == self.p - 1 and k[self.p] == "{" and k[at + 2] not in ("t", "q"):
                self.stmt()
                return
            raise Bad

    def condition(self) -> None:
        self.need("(")
        self.exprs()
        self.need(")")

    def declares(self) -> bool:
        """Whether a declaration, not an expression, begins here."""
        k, at = self.k, self.p
        t = k[at]
        if t in _TYPE_START:
            return True
        if t not in _NAME:
            return False
        n = k[at + 1]
        if n in _NAME or n in _TYPE_START:
            return t == "i" or k[at + 2] != "("
        if t == "M" and n == "(":
            at = self.mate(at + 1)
            n = k[at + 1]
            if n in _NAME:
                return k[at + 2] in (";", "=", ",", "[")
        if n == "*":
            at += 1
            while k[at] in ("*", "q"):
                at += 1
            return k[at] in _NAME and k[at + 1] in (";", "=", ",", "[")
        return n == "(" and k[at + 2] == "*" and k[at + 3] in _NAME and k[at + 4] == ")" and k[at + 5] == "("


def _branches(kinds: list[str], last: bool) -> list[str]:
    """The kinds without directives, of conditional sections the first or the last branch only."""
    out: list[str] = []
    stack: list[list] = []  # [kept now, first branch, where the branch began in out]
    live = True
    for kind in kinds:
        if kind[:1] != "#":
            if live:
                out.append(kind)
            continue
        if kind in ("#if", "#if0"):
            stack.append([live, kind == "#if0", len(out)])
            live = live and kind != "#if0"
        elif not stack:
            raise Bad
        elif kind == "#else":
            outer, dead, at = stack[-1]
            if last and outer and not dead:
                del out[at:]
            live = outer and (last or dead)
            stack[-1][1] = False
        else:
            live = stack.pop()[0]
    if stack:
        raise Bad
    return out


class _CGrammar(Grammar):
    def part(self, kinds: list[str]) -> list[str]:
        return kinds[: next((i for i, x in enumerate(kinds) if x[0] == "#"), len(kinds))]

    def holds(self, kinds: list[str]) -> bool:
        kinds = kinds[: -len(END)]
        if not any(x[0] == "#" for x in kinds):
            return super().holds([*kinds, *END])
        try:
            return any(super(_CGrammar, self).holds([*_branches(kinds, last), *END]) for last in (False, True))
        except Bad:
            return False


C = _CGrammar(_TOKENS, _kind, _C, "")
