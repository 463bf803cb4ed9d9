"""Parsers that tell whether a source text is valid syntax of a language.

Python is parsed by Python itself; the other languages by a lexer and a recursive-descent grammar each (``base``). They
follow syntax only: types, names and constant values may be anything. What they leave out: JSX, C beyond its
preprocessor (a macro in small letters that hides syntax), macros of Rust, which are token trees, and Ruby's rarest
shapes (a here document within another's interpolation, flip-flops of commands).
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable

from quarrylight.llm.grammars.c import C
from quarrylight.llm.grammars.go import GO
from quarrylight.llm.grammars.java import JAVA
from quarrylight.llm.grammars.ruby import RUBY
from quarrylight.llm.grammars.rust import RUST
from quarrylight.llm.grammars.script import JS, TS

#: Extensions of the languages that are parsed; fixed by the data.
EXTENSIONS = ("py", "rs", "go", "js", "ts", "java", "c", "rb")


def _python(text: str) -> bool | None:
    """None where the text is nested beyond what Python's parser holds, so that nothing is known of it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return False
    return True


_GRAMMARS = {"rs": RUST, "go": GO, "js": JS, "ts": TS, "java": JAVA, "c": C, "rb": RUBY}
PARSERS: dict[str, Callable[[str], bool | None]] = {"py": _python} | {name: g.valid for name, g in _GRAMMARS.items()}
#: The same parsers for texts that are perhaps of another language: most fail at their first tokens.
FOREIGN: dict[str, Callable[[str], bool | None]] = {"py": _python} | {name: g.foreign for name, g in _GRAMMARS.items()}
