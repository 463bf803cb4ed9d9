"""Ruby. Its lexer keeps track of what precedes a sign, because a slash, a percent sign, a bracket or a minus mean one
thing after a value and another before one; its grammar reads commands without parentheses, blocks and modifiers."""

from __future__ import annotations

import re

from quarrylight.llm.grammars.base import END, HEADS, REMEMBERED, Bad, Kinds, Reader

_KEYWORDS = set("def class module do if unless while until for in case when else elsif begin rescue ensure end return next break redo retry yield and or not then super alias undef defined? BEGIN END".split())
_VALUES = set("true false nil self __FILE__ __LINE__ __method__ __dir__ __ENCODING__".split())
_TOKENS = re.compile(
    r"(?P<space>(?:[ \t\f\v]|\\\r?\n)*+)(?:(?P<line>\n[ \t\r\f\v]*(?:\#[^\n]*|(?=(?:&\.|\.(?!\.))))?)|(?P<begin>^=begin\b.*?^=end\b[^\n]*)|(?P<comment>\#[^\n]*)"
    r"|(?P<heredoc><<[~-]?(?:\"[^\"\n]+\"|'[^'\n]+'|`[^`\n]+`|[A-Za-z_]\w*))|(?P<number>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]*(?![\w.])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*(?!\w))"
    r"|(?P<ivar>@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|\d+|-\w|[!@&`'+~=/\\,;.<>_*$?:\"]))"
    r"|(?P<symbol>:(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*[?!]?|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+\-]@|[+\-*/%&|^<>~`](?!:)))"
    r"|(?P<word>[^\W\d]\w*(?:[?!](?![=~])|[?!](?==[=~>]))?)|(?P<sign>\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|::|\.\.|=>|=~|!~|\*\*|<<|>>|&&|\|\||->|[+\-*/%&|^<>=!]=|[\"'`/%?:\[\](){},;.+\-*&|^<>=!~])|(?P<bad>.))",
    re.M | re.S,
)
_CONFLICT = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?![<>=|])")
_CALL_GOES_ON = re.compile(r"[ \t]*(?:&\.|\.(?!\.))")
_AFTER_COMMENTS = re.compile(r"(?:\n[ \t]*(?:#[^\n]*)?)*\n[ \t]*(?:&\.|\.(?!\.))")
_PERCENT = re.compile(r"%([wWiIqQrsx]?)([^\w\s])")
_CHARACTER = re.compile(r"\?(?:\\.|[^\s\\])(?!\w)")
_IN_HEREDOC = re.compile(r"\\.|#\{", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_BINARY = set("+ - * / % & | ^ < > && || << >> == != <= >= ** <=> === =~ !~ .. ...".split())
_ASSIGN = set("= += -= *= /= %= &= |= ^= **= <<= >>= &&= ||=".split())
_OPERATOR_METHODS = set("+ - * / % & | ^ < > << >> == != <= >= ** <=> === =~ !~ ! ~ `".split())
#: Kinds after which a value may begin, so that a slash, a percent sign or a question mark belongs to it.
_VALUE_ENDS = {"i", "C", "v", "s", "ivar", ")", "]", "}", "end", "i?"}


class _Unclosed(Exception):
    pass


class _Lexer:
    """Kinds of a text, whether a space precedes each, and apart from them the code within strings."""

    def __init__(self, text: str, at: int = 0, until: str = "", inner: list | None = None, most: int = 0) -> None:
        self.text, self.at, self.until, self.most = text, at, until, most
        self.kinds: list[str] = []
        self.spaces = bytearray()
        self.inner: list = [] if inner is None else inner
        self.waiting: list[tuple[str, bool, bool]] = []
        self.space = self.depth = 0
        self.run()

    def put(self, kind: str) -> None:
        self.kinds.append(kind)
        self.spaces.append(self.space)
        self.space = 0

    def run(self) -> None:
        text, match = self.text, _TOKENS.match
        size = len(text)
        most = self.most or size + 1
        kinds = self.kinds
        while self.at < size:
            m = match(text, self.at)
            if m is None:
                break  # nothing but space
            kind = m.lastgroup
            start, end = m.span(kind)
            if start > self.at:
                self.space = 1
            if kind == "comment" or kind == "begin":
                self.at = end
                continue
            if len(kinds) >= most:
                return
            self.at = start
            token = text[start:end]
            last = kinds[-1] if kinds else "\n"
            ends = last in _VALUE_ENDS
            if kind == "line":
                if self.waiting:
                    self.at += 1
                    self.bodies()
                    continue_line = _CALL_GOES_ON.match(text, self.at)
                else:
                    continue_line = m.end() < size and text[m.end()] in ".&" and token[-1:] != "\n" or token == "\n" and _CALL_GOES_ON.match(text, m.end())
                    comment = token.lstrip("\n \t\r\f\v").startswith("#")
                    self.at = m.end()
                    if comment and _AFTER_COMMENTS.match(text, self.at):
                        self.space = 1
                        continue
                if not continue_line:
                    if last != "\n":
                        self.put("\n")
                    if text.startswith("__END__", self.at) and text[self.at + 7 : self.at + 8] in ("", "\n", "\r"):
                        self.at = size
                        return
                self.space = 1
                continue
            after_def = last == "." or last == "def" or last == "&." or last == "::" and not self.space
            if kind == "word":
                at = self.at = end
                n = text[at : at + 1]
                if n != ":" and n != "=" and n != "?" and not after_def and token not in _KEYWORDS and token not in _VALUES:
                    kinds.append("C" if token[0].isupper() else "i?" if token[-1] in "?!" else "i")
                    self.spaces.append(self.space)
                    self.space = 0
                elif n == ":" and text[self.at + 1 : self.at + 2] != ":" and last not in (".", "&.") and not (last == "?" and self.space and text[self.at + 1 : self.at + 2] not in (" ", "\n")) and not self.ternary(last):
                    self.at += 1
                    self.put("label")
                elif after_def and last != "def":
                    self.put("C" if token[0].isupper() else "i")
                elif token == "defined" and n == "?":
                    self.at += 1
                    self.put("defined?")
                elif last == "def" and token not in ("self",):
                    if n == "=" and text[self.at + 1 : self.at + 2] not in ("=", "~", ">", " ") :
                        self.at += 1
                    self.put("C" if token[0].isupper() else "i")
                elif token in _KEYWORDS:
                    self.put(token)
                elif token in _VALUES:
                    self.put("v" if token != "self" else "self")
                else:
                    self.put("C" if token[0].isupper() else "i?" if token[-1] in "?!" else "i")
                continue
            if kind == "number" or kind == "ivar":
                self.at = m.end()
                self.put("v" if kind == "number" else "ivar")
                continue
            if kind == "symbol" and not (last == "?" and not self.space) and not (ends and not self.space and last != "("):
                self.at = m.end()
                self.put("v")
                continue
            if kind == "symbol":
                token = ":"
            if kind == "heredoc":
                if not ends or self.space and token[2] in "~-\"'" or self.space and last == "i" and text[m.end() : m.end() + 1] not in (" ",) and token[2:].isupper():
                    self.at = m.end()
                    mark = token[2:].lstrip("~-")
                    self.waiting.append((mark.strip("\"'`"), token[2] in "~-", mark[0] != "'"))
                    self.put("s")
                    continue
                token = "<<"
            if kind == "bad" or token[0] in "<=>|" and (self.at == 0 or text[self.at - 1] == "\n") and _CONFLICT.match(text, self.at):
                self.put("X")
                return
            self.at = start + len(token)
            before_value = not ends or self.space and last in ("i", "i?") and text[self.at : self.at + 1] not in (" ", "\n", "=", "")
            if after_def and token in _OPERATOR_METHODS:
                if token in "+-!~" and text.startswith("@", self.at):
                    self.at += 1
                self.put("i")
                continue
            if after_def and token == "[" and text.startswith("]", self.at):
                self.at += 1
                if text.startswith("=", self.at) and text[self.at + 1 : self.at + 2] not in "=~>":
                    self.at += 1
                self.put("i")
                continue
            if token in "\"'`":
                self.string(token, token, token != "'")
                if text.startswith(":", self.at) and not text.startswith("::", self.at) and token != "`" and last in ("{", ",", "(", "\n", "|", "i", "label") and not self.ternary(last):
                    self.at += 1
                    self.put("label")
                else:
                    self.put("s")
                continue
            if token == ":" and text[self.at : self.at + 1] in ("\"", "'") and not ends:
                quote = text[self.at]
                self.at += 1
                self.string(quote, quote, quote == '"')
                self.put("v")
                continue
            if token in ("/", "/=") and before_value:
                self.at = start + 1
                self.string("/", "/", True)
                while text[self.at : self.at + 1].isalpha():
                    self.at += 1
                self.put("v")
                continue
            if token in ("%", "%=") and before_value:
                found = _PERCENT.match(text, start)
                if found:
                    self.at = found.end()
                    self.string(found[2], _CLOSE.get(found[2], found[2]), found[1] not in ("w", "i", "q", "s"))
                    if found[1] == "r":
                        while text[self.at : self.at + 1].isalpha():
                            self.at += 1
                    self.put("v")
                    continue
            if token == "?" and not ends:
                found = _CHARACTER.match(text, start)
                if found:
                    self.at = found.end()
                    self.put("v")
                    continue
            if token in ("{", "(", "["):
                self.depth += 1
                self.put(token)
                continue
            if token in ("}", ")", "]"):
                if self.until == "}" and token == "}" and self.depth == 0:
                    return
                self.depth -= 1
                self.put(token)
                continue
            if token == ";":
                token = "\n"
            self.put(token)
        if self.until:
            raise _Unclosed

    def ternary(self, last: str) -> bool:
        """Whether a colon after a word may belong to a question mark on its line."""
        n = 0
        for kind in reversed(self.kinds):
            if kind in ("\n", "{", "(", "[", "|"):
                break
            n += (kind == "?") - (kind == ":")
            if kind in ("?",) and n > 0:
                return True
        return False

    def string(self, open_: str, close: str, interpolates: bool) -> None:
        """The rest of a string after its opening sign."""
        text, at, depth = self.text, self.at, 0
        find = re.compile(r"\\|\#\{|" + re.escape(close) + ("|" + re.escape(open_) if open_ != close else "")).search
        while True:
            m = find(text, at)
            if m is None:
                raise _Unclosed
            at = m.end()
            if m[0] == "\\":
                at += 1
            elif m[0] == "#{":
                if interpolates:
                    code = _Lexer(text, at, "}", self.inner)
                    self.inner.append((code.kinds, code.spaces))
                    at = code.at
            elif m[0] == close:
                if depth == 0:
                    break
                depth -= 1
            else:
                depth += 1
        self.at = at

    def bodies(self) -> None:
        """The texts that heredocs of the last line announced."""
        text = self.text
        for mark, indented, interpolates in self.waiting:
            end = re.compile((r"^[ \t]*" if indented else "^") + re.escape(mark) + r"\r?$", re.M).search(text, self.at)
            if end is None:
                raise _Unclosed
            if interpolates:
                at = self.at
                for m in iter(lambda: _IN_HEREDOC.search(text, at, end.start()), None):
                    at = m.end()
                    if m[0] == "#{":
                        code = _Lexer(text, at, "}", self.inner)
                        self.inner.append((code.kinds, code.spaces))
                        at = code.at
            self.at = min(len(text), end.end() + 1)
        self.waiting = []


_ENDS = {"\n", "", "end", "}", ")", "]", "else", "elsif", "when", "in", "rescue", "ensure", "then", "do"}
_MODIFIERS = {"if", "unless", "while", "until", "rescue"}
_STARTS = {"i", "i?", "C", "v", "s", "ivar", "self", "label", "->", "not", "defined?", "super", "yield", "case", "if", "unless", "while", "begin", "def", "class", "!", "~", "..", "...", "nil"}


#: Statements that have been read, with the spaces within them.
_KNOWN: dict[tuple, set[bytes]] = {}
_WRONG: set[tuple] = set()  # beginnings that have been seen to be no beginning


class _Ruby(Reader):
    no_do = False  # in the head of a loop, where do begins its body

    def __init__(self, kinds: list[str], spaces: bytearray) -> None:
        super().__init__(kinds)
        self.spaces = spaces

    def attempt(self, rule) -> bool:
        no_do = self.no_do
        if super().attempt(rule):
            return True
        self.no_do = no_do
        return False

    def lines(self) -> None:
        while self.k[self.p] == "\n":
            self.p += 1

    def file(self) -> None:
        self.stmts()
        if self.k[self.p]:
            raise Bad

    def stmts(self) -> None:
        k, known = self.k, _KNOWN
        self.lines()
        while k[self.p] not in ("", "end", "}", ")", "else", "elsif", "when", "in", "rescue", "ensure"):
            at = self.p
            short = self.recalled("\n", known)
            if short is None:
                spaces = bytes(self.spaces[at : self.p])
                if spaces in known[tuple(k[at : self.p - 1])]:
                    self.lines()
                    continue
                self.p, short = at, (self.p - 1, tuple(k[at : self.p - 1]))
            self.stmt()
            if self.p == short[0] and len(known) < REMEMBERED and not self.no_do:
                known.setdefault(short[1], set()).add(bytes(self.spaces[at : self.p + 1]))
            if k[self.p] == "\n":
                self.lines()
            elif k[self.p] not in ("", "end", "}", ")", "else", "elsif", "when", "in", "rescue", "ensure"):
                raise Bad

    def stmt(self) -> None:
        k = self.k
        self.expr_stmt()
        while k[self.p] in _MODIFIERS:
            self.p += 1
            self.expr_stmt()

    def expr_stmt(self) -> None:
        k = self.k
        while True:
            while self.take("not") or k[self.p] == "!" and self.take("!"):
                pass
            self.tuple()
            if k[self.p] in ("and", "or"):
                self.p += 1
                self.lines()
                continue
            if k[self.p] == "=>" or k[self.p] == "in" and not self.no_do:
                if k[self.p] == "in":
                    return
                self.p += 1
                self.pattern()
            return

    def tuple(self) -> None:
        """An expression, or targets and values of a parallel assignment."""
        k, t = self.k, self.k[self.p]
        if t in ("*", "**") or t in ("i", "ivar", "C", "self", "("):
            at = self.p
            if self.targets_ahead():
                def rule() -> None:
                    n = 0
                    while True:
                        self.take("*")
                        if k[self.p] not in ("=", ","):
                            if k[self.p] == "(":
                                self.nested_targets()
                            else:
                                self.primary(False)
                        n += 1
                        if not self.take(","):
                            break
                        if k[self.p] == "=":
                            break
                    self.need("=")
                if self.attempt(rule):
                    self.lines()
                    self.values()
                    return
                self.p = at
        self.expr()
        if k[self.p] == "," and k[self.p - 1] not in _MODIFIERS and self.assigned:
            while self.take(","):
                self.lines()
                self.take("*")
                self.expr()

    assigned = False

    def nested_targets(self) -> None:
        self.need("(")
        while True:
            self.take("*")
            if self.k[self.p] == "(":
                self.nested_targets()
            elif self.k[self.p] not in (")", ","):
                self.primary(False)
            if not self.take(","):
                break
        self.need(")")

    def targets_ahead(self) -> bool:
        """Whether a comma and an equals sign stand on this line outside of brackets."""
        k, at, comma = self.k, self.p, self.k[self.p] == "*"
        while True:
            t = k[at]
            if t in ("(", "[", "{"):
                at = self.mate(at)
            elif t == ",":
                comma = True
            elif t in _ASSIGN:
                return comma and t == "="
            elif t not in ("i", "ivar", "C", "self", ".", "&.", "::", "*"):
                return False
            at += 1

    def values(self) -> None:
        while True:
            self.take("*")
            self.expr()
            if not self.take(","):
                return
            self.lines()

    def expr(self) -> None:
        """Operands and operators, conditions with ? and :, assignments."""
        k = self.k
        self.assigned = False
        while True:
            if k[self.p] in ("..", "..."):
                self.p += 1
            self.unary()
            t = k[self.p]
            if t == "?":
                self.p += 1
                self.lines()
                if k[self.p] == "label":  # a word and the colon right after it
                    self.p += 1
                else:
                    self.expr()
                    self.lines()
                    if k[self.p] == "label":
                        raise Bad
                    if k[self.p] != ":":
                        raise Bad
                    self.p += 1
                self.lines()
                self.expr()
                return
            if t in _ASSIGN:
                if k[self.p - 1] not in ("i", "C", "ivar", "]", "i?"):
                    raise Bad
                self.p += 1
                self.lines()
                if k[self.p] == "*":
                    self.p += 1
                self.expr()
                if k[self.p] == "rescue":
                    self.p += 1
                    self.expr()
                self.assigned = t == "="
                return
            if t in _BINARY:
                self.p += 1
                self.lines()
                if t in ("..", "...") and k[self.p] in _ENDS | {",", "=>"}:
                    return
                while k[self.p] == "not":
                    self.p += 1
                continue
            return

    def unary(self) -> None:
        k = self.k
        while k[self.p] in ("-", "+", "!", "~", "&", "defined?", "**", "not", "*"):
            t = k[self.p]
            self.p += 1
            if t in ("&", "*", "**") and k[self.p] in (")", ",", "]", "|"):
                return
        self.primary(True)

    def starts(self, at: int) -> bool:
        """Whether an argument of a command without parentheses begins at a place."""
        k, t = self.k, self.k[at]
        if t in _STARTS:
            return t not in ("if", "unless", "while") and (t not in ("..", "..."))
        if not self.spaces[at]:
            return False
        if t in ("-", "*", "&", "**", "::", ":", "+"):
            return not self.spaces[at + 1]
        if t == "[":
            return True
        return t == "!"

    def primary(self, commands: bool) -> None:
        k, t = self.k, self.k[self.p]
        if t in ("i", "i?", "super", "C"):
            self.p += 1
            n = k[self.p]
            if n == "(" and (not self.spaces[self.p] or t == "super"):
                self.args(")")
            elif t != "C" and commands and self.starts(self.p) or t == "C" and commands and k[self.p] in ("s", "v", "i") and self.spaces[self.p]:
                self.command()
            elif n == "(" and commands and t != "C":
                self.command()
        elif t == "s":
            self.p += 1
            while k[self.p] == "s":
                self.p += 1
        elif t in ("v", "ivar", "self"):
            self.p += 1
        elif t == "(":
            self.p += 1
            no_do, self.no_do = self.no_do, False
            self.stmts()
            self.no_do = no_do
            self.need(")")
        elif t == "[":
            self.args("]")
        elif t == "{":
            self.hash()
        elif t == "::":
            self.p += 1
            self.need("C")
        elif t == "->":
            self.p += 1
            if k[self.p] == "(":
                self.params("(")
            elif k[self.p] not in ("{", "do"):
                self.params("")
            if k[self.p] == "{":
                self.p += 1
                self.within(self.stmts)
                self.need("}")
            else:
                self.need("do")
                self.within(self.body)
        elif t in ("if", "unless"):
            self.p += 1
            self.within(self.expr_stmt)
            self.then()
            self.stmts()
            while self.take("elsif"):
                self.within(self.expr_stmt)
                self.then()
                self.stmts()
            if self.take("else"):
                self.stmts()
            self.need("end")
        elif t in ("while", "until"):
            self.p += 1
            self.head(self.expr_stmt)
            self.within(self.stmts)
            self.need("end")
        elif t == "for":
            self.p += 1
            while True:
                self.take("*")
                if k[self.p] == "(":
                    self.nested_targets()
                elif k[self.p] in ("i", "ivar"):
                    self.p += 1
                else:
                    raise Bad
                if not self.take(","):
                    break
            self.need("in")
            self.head(self.values)
            self.within(self.stmts)
            self.need("end")
        elif t == "case":
            self.case()
        elif t == "begin":
            self.p += 1
            self.within(self.body)
        elif t == "def":
            self.define()
        elif t == "class":
            self.p += 1
            if self.take("<<"):
                self.expr()
            else:
                self.constant()
                if self.take("<"):
                    self.expr()
            if k[self.p] != "\n":
                raise Bad
            self.within(self.body)
        elif t == "module":
            self.p += 1
            self.constant()
            if k[self.p] not in ("\n", "end"):
                raise Bad
            self.within(self.stmts)
            self.need("end")
        elif t in ("return", "break", "next", "yield"):
            self.p += 1
            if t == "yield" and k[self.p] == "(" and not self.spaces[self.p]:
                self.args(")")
            elif k[self.p] not in _ENDS and k[self.p] not in _MODIFIERS and k[self.p] not in ("and", "or", ":", ",", "&&", "||", "?", ".", "&.") and not (t == "yield" and k[self.p] == "[" and not self.spaces[self.p]):
                if t == "yield" and not self.starts(self.p) and k[self.p] not in ("(", "[", "{", "-", "*", "!"):
                    pass
                else:
                    self.command()
                    if t != "yield":
                        return
        elif t in ("redo", "retry"):
            self.p += 1
            return
        elif t == "alias":
            self.p += 1
            self.p += 2
            if any(x not in ("i", "i?", "v", "C", "ivar") and x not in _OPERATOR_METHODS for x in k[self.p - 2 : self.p]):
                raise Bad
            return
        elif t == "undef":
            self.p += 1
            while True:
                if k[self.p] not in ("i", "i?", "v"):
                    raise Bad
                self.p += 1
                if not self.take(","):
                    return
        elif t in ("BEGIN", "END"):
            self.p += 1
            self.need("{")
            self.within(self.stmts)
            self.need("}")
            return
        elif t in ("not", "!", "defined?", "-"):
            self.p += 1
            self.unary()
            return
        else:
            raise Bad
        self.postfix(commands, t)

    def within(self, rule) -> None:
        no_do, self.no_do = self.no_do, False
        rule()
        self.no_do = no_do

    def head(self, rule) -> None:
        no_do, self.no_do = self.no_do, True
        rule()
        self.no_do = no_do
        if not self.take("do") and self.k[self.p] != "\n":
            raise Bad

    def then(self) -> None:
        if self.k[self.p] == "\n":
            self.lines()
            self.take("then")
        else:
            self.need("then")

    def constant(self) -> None:
        self.take("::")
        self.need("C")
        while self.take("::"):
            self.need("C")

    def postfix(self, commands: bool, first: str) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t in (".", "&.", "::"):
                self.p += 1
                self.lines()
                if k[self.p] == "(":
                    self.args(")")
                    continue
                name = k[self.p]
                if name not in ("i", "i?", "C", "self", "v") and not name.isalpha() and name != "label":
                    raise Bad
                self.p += 1
                if name == "label":
                    continue
                first = "i"
                if k[self.p] == "(" and not self.spaces[self.p]:
                    self.args(")")
                elif name != "C" and commands and (self.starts(self.p) or k[self.p] == "(" and self.spaces[self.p]):
                    self.command()
                elif name == "C" and commands and t != "::" and k[self.p] in ("s", "v", "i"):
                    self.command()
            elif t == "[" and not self.spaces[self.p]:
                self.args("]")
            elif t == "[" and first not in ("i", "i?"):
                self.args("]")
            elif t == "{" and first in ("i", "i?", "super", "C", "yield"):
                self.p += 1
                no_do, self.no_do = self.no_do, False
                self.block_params()
                self.stmts()
                self.no_do = no_do
                self.need("}")
                first = ")"
            elif t == "do" and not self.no_do and commands and first in ("i", "i?", "super", "C", ")", "yield"):
                self.p += 1
                no_do, self.no_do = self.no_do, False
                self.block_params()
                self.body()
                self.no_do = no_do
                first = ")"
            else:
                return

    def block_params(self) -> None:
        if self.take("||"):
            return
        if self.k[self.p] == "|":
            self.params("|")

    def command(self) -> None:
        """Arguments without parentheses."""
        k = self.k
        while True:
            self.argument()
            if not self.take(","):
                return
            self.lines()

    def argument(self) -> None:
        k = self.k
        if k[self.p] == "label":
            self.p += 1
            if k[self.p] in (",", ")", "]", "\n", "", "}", "do", "if", "unless"):
                if k[self.p] == "\n":
                    at = self.p
                    self.lines()
                    if k[self.p] in (")", "]", "}", "end", "", "label"):
                        self.p = at
                        return
                else:
                    return
            self.expr_or_command()
            return
        if k[self.p] in ("*", "**", "&", "..."):
            self.p += 1
            if k[self.p] in (",", ")", "]", "\n"):
                return
        self.expr_or_command()
        if self.take("=>"):
            self.lines()
            self.expr_or_command()

    def expr_or_command(self) -> None:
        self.take("not")
        self.expr()

    def args(self, close: str) -> None:
        k = self.k
        self.p += 1
        no_do, self.no_do = self.no_do, False
        self.lines()
        while not self.take(close):
            self.argument()
            self.lines()
            if k[self.p] in _MODIFIERS and close == ")":
                self.p += 1
                self.expr_stmt()
                self.lines()
            if not self.take(","):
                self.need(close)
                break
            self.lines()
        self.no_do = no_do

    def hash(self) -> None:
        k = self.k
        self.need("{")
        no_do, self.no_do = self.no_do, False
        self.lines()
        while not self.take("}"):
            if k[self.p] == "label":
                self.p += 1
                self.lines()
                if k[self.p] not in (",", "}"):
                    self.expr_or_command()
            elif self.take("**"):
                self.expr()
            else:
                self.expr()
                self.lines()
                self.need("=>")
                self.lines()
                self.expr_or_command()
            self.lines()
            if not self.take(","):
                self.need("}")
                break
            self.lines()
        self.no_do = no_do

    def params(self, open_: str) -> None:
        """Parameters in parentheses, between bars, or up to the end of the line."""
        k = self.k
        close = {"(": (")",), "|": ("|",), "": ("\n", "{", "do", "=")}[open_]
        if open_:
            self.p += 1
        if open_:
            self.lines()
        while k[self.p] not in close:
            t = k[self.p]
            if t in ("*", "**", "&"):
                self.p += 1
                if k[self.p] == "i":
                    self.p += 1
            elif t == "...":
                self.p += 1
            elif t == "(":
                self.nested_targets()
            elif t == "label":
                self.p += 1
                if k[self.p] not in (",", "\n", *close):
                    self.default(open_)
            elif t == "i":
                self.p += 1
                if self.take("="):
                    self.default(open_)
            elif t == "\n" and open_ == "|":  # names of the block's own
                self.p += 1
                while self.take("i"):
                    if not self.take(","):
                        break
                break
            else:
                raise Bad
            if open_ == "(":
                self.lines()
            if not self.take(","):
                if k[self.p] == "\n" and open_ == "|":
                    continue
                break
            self.lines()
        if open_:
            self.need(close[0])

    def default(self, open_: str) -> None:
        if open_ == "|":
            self.unary()  # a bar ends the parameters
            while self.k[self.p] in _BINARY and self.k[self.p] != "|":
                self.p += 1
                self.unary()
        else:
            self.expr()

    def body(self) -> None:
        """Statements with their rescue, else and ensure, up to end."""
        k = self.k
        self.stmts()
        while self.take("rescue"):
            while k[self.p] not in ("\n", "then", "=>"):
                self.take("*")
                self.expr()
                if not self.take(","):
                    break
                self.lines()
            if self.take("=>"):
                self.primary(False)
            if k[self.p] == "then":
                self.p += 1
            elif k[self.p] != "\n":
                raise Bad
            self.stmts()
        if self.take("else"):
            self.stmts()
        if self.take("ensure"):
            self.stmts()
        self.need("end")

    def define(self) -> None:
        k = self.k
        self.p += 1
        t = k[self.p]
        if (t in ("self", "i", "C", "ivar")) and k[self.p + 1] in (".", "::"):
            self.p += 2
            t = k[self.p]
        if not (t in ("i", "i?", "C", "label") or t in _KEYWORDS or t in ("v", "self")):
            raise Bad
        if t == "label":
            raise Bad
        self.p += 1
        if k[self.p] == "=" and not self.spaces[self.p] and k[self.p + 1] in ("(", "i") and self.spaces[self.p + 1] == 0:
            self.p += 1
        if k[self.p] == "(":
            self.params("(")
        elif k[self.p] not in ("\n", "="):
            self.params("")
        if self.take("="):
            self.lines()
            self.within(self.stmt)
            return
        if k[self.p] not in ("\n", "end") and k[self.p - 1] != ")":
            raise Bad
        self.within(self.body)

    def case(self) -> None:
        k = self.k
        self.p += 1
        if k[self.p] != "\n":
            self.within(self.expr_stmt)
        self.lines()
        n = 0
        no_do, self.no_do = self.no_do, False
        while k[self.p] in ("when", "in"):
            n += 1
            self.p += 1
            if k[self.p - 1] == "when":
                while True:
                    self.take("*")
                    self.expr()
                    if not self.take(","):
                        break
                    self.lines()
            else:
                self.pattern()
                if k[self.p] in ("if", "unless"):
                    self.p += 1
                    self.expr_stmt()
            self.then()
            self.stmts()
        if self.take("else"):
            self.stmts()
        if not n:
            raise Bad
        self.no_do = no_do
        self.need("end")

    def pattern(self) -> None:
        """Patterns with commas at their top."""
        k = self.k
        while True:
            self.one_pattern()
            if not self.take(","):
                return
            if k[self.p] in ("\n", "then", "if", "unless"):
                return

    def one_pattern(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t in ("*", "**"):
                self.p += 1
                if k[self.p] in ("i", "v"):
                    self.p += 1
            elif t == "label":
                self.p += 1
                if k[self.p] not in (",", "\n", "}", ")", "then", "if", "unless"):
                    self.one_pattern()
            elif t in ("[", "{", "("):
                self.p += 1
                self.patterns({"[": "]", "{": "}", "(": ")"}[t])
            elif t == "^":
                self.p += 1
                if k[self.p] == "(":
                    self.args(")")
                else:
                    self.p += 1
            elif t == "C" or t == "::":
                self.constant()
                if k[self.p] in ("(", "[") and not self.spaces[self.p]:
                    close = ")" if k[self.p] == "(" else "]"
                    self.p += 1
                    self.patterns(close)
            elif t in ("i", "v", "ivar", "s", "-", "..", "...", "->", "self"):
                if t in ("..", "...", "-"):
                    self.p += 1
                if t == "->":
                    self.primary(False)
                else:
                    self.p += 1
            else:
                raise Bad
            if k[self.p] in ("..", "..."):
                self.p += 1
                if k[self.p] in ("v", "s", "C", "-"):
                    self.p += 1
            if self.take("=>"):
                self.need("i")
            if not self.take("|"):
                return

    def patterns(self, close: str) -> None:
        self.lines()
        while not self.take(close):
            self.one_pattern()
            self.lines()
            if not self.take(","):
                self.need(close)
                return
            self.lines()


class RubyGrammar:
    reader = _Ruby
    kinds = Kinds(lambda token: token)

    def make(self, text: str) -> _Ruby:
        code = _Lexer(text)
        return _Ruby([*code.kinds, *END], code.spaces + b"\1" * len(END))

    def whole(self, text: str) -> list[str]:
        return _Lexer(text).kinds

    def valid(self, text: str) -> bool:
        try:
            code = _Lexer(text)
            if code.waiting:
                code.at = len(text)
                return False
            for kinds, spaces in [(code.kinds, code.spaces), *code.inner]:
                if "X" in kinds:
                    return False
                _Ruby([*kinds, *END], spaces + b"\1" * len(END)).file()
        except (_Unclosed, Bad, IndexError):
            return False
        return True

    def foreign(self, text: str) -> bool:
        code = None
        for most in HEADS:
            try:
                if code is None:
                    code = _Lexer(text, most=most)
                else:
                    code.most = most
                    code.run()
                key = (tuple(code.kinds), bytes(code.spaces))
                if key in _WRONG:
                    return False
                _Ruby(code.kinds, code.spaces).file()
            except _Unclosed:
                return False
            except Bad:
                if len(_WRONG) < REMEMBERED:
                    _WRONG.add(key)
                return False
            except IndexError:
                pass  # the head is valid as far as it goes
        return self.valid(text)


RUBY = RubyGrammar()
