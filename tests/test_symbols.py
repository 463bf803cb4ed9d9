from __future__ import annotations

import pytest

from quarrylight.operators.symbols import symbols_of

CASES = {
    "cpp": ("namespace a {\ntemplate <typename T> class B : public C {\n  void m(int a) const {\n  }\n  int f;\n};\nstruct S {\n};\nenum class E { A };\nusing U = int;\nint B::g(int x) {\n  return x;\n}\nstatic int h() {\n}\n}\n", [("a", "Namespace", 1, 16), ("B", "Class", 2, 6), ("m", "Method", 3, 4), ("f", "Variable", 5, 5), ("S", "Struct", 7, 8), ("E", "Enum", 9, 9), ("U", "Type", 10, 10), ("g", "Method", 11, 13), ("h", "Function", 14, 15)]),
    "csharp": ("namespace A.B;\n[Serializable]\npublic sealed class C : D\n{\n    private readonly int x = 1;\n    public string Name { get; set; }\n    public event Handler Changed;\n    public int this[int i] => i;\n    public async Task<int> Run(int a)\n    {\n        var y = 2;\n    }\n}\npublic record R(int A);\ndelegate void H(int x);\n", [("A.B", "Namespace", 1, 1), ("Serializable", "Attribute", 2, 2), ("C", "Class", 3, 13), ("x", "Variable", 5, 5), ("Name", "Variable", 6, 6), ("Changed", "Event", 7, 7), ("this", "Property", 8, 8), ("Run", "Method", 9, 12), ("y", "Variable", 11, 11), ("R", "Type", 14, 14), ("H", "Type", 15, 15)]),
    "php": ("<?php\nnamespace App\\X;\nabstract class A extends B {\n    const K = 1;\n    private ?int $p = 1;\n    public function m(): int {\n        $x = 1;\n    }\n}\nfunction f() {}\ntrait T {}\n", [("App\\X", "Namespace", 2, 2), ("A", "Class", 3, 9), ("K", "Constant", 4, 4), ("p", "Variable", 5, 5), ("m", "Method", 6, 8), ("x", "Variable", 7, 7), ("f", "Function", 10, 10), ("T", "Trait", 11, 11)]),
    "kotlin": ("@Ann\ndata class A(val x: Int) {\n    fun m(): Int {\n        var z = 2\n    }\n}\ninterface I\nfun <T> f(x: T) = x\nconst val C = 1\n", [("Ann", "Attribute", 1, 1), ("A", "Class", 2, 6), ("m", "Method", 3, 5), ("z", "Variable", 4, 4), ("I", "Interface", 7, 7), ("f", "Function", 8, 8), ("C", "Constant", 9, 9)]),
    "zig": ("const std = @import(\"std\");\npub const P = struct {\n    pub fn init() P {\n    }\n};\nvar v: i32 = 1;\ntest \"adds\" {\n}\n", [("std", "Constant", 1, 1), ("P", "Struct", 2, 5), ("init", "Function", 3, 4), ("v", "Variable", 6, 6), ("adds", "Function", 7, 8)]),
    "vue": ("<template>\n</template>\n<script setup lang=\"ts\">\nconst a = 1\nfunction f() {\n}\n</script>\n", [("a", "Constant", 4, 4), ("f", "Function", 5, 6)]),
    "svelte": ("<script>\n  let n = 1;\n  $: twice = n * 2;\n</script>\n", [("n", "Variable", 2, 2), ("twice", "Variable", 3, 3)]),
    "java": ("@Foo\npublic class A {\n    private int x = 1;\n    A(int y) {\n    }\n    public <T> List<T> m(T t) throws E {\n        String s = \"a\";\n        return null;\n    }\n}\n", [("Foo", "Attribute", 1, 1), ("A", "Class", 2, 10), ("x", "Variable", 3, 3), ("A", "Method", 4, 5), ("m", "Method", 6, 9), ("s", "Variable", 7, 7)]),
    "ruby": ("class A\n  attr_reader :b\n  X = 1\n  def m!\n    @c = 1\n    d = 2\n  end\nend\n", [("A", "Class", 1, 8), ("b", "Property", 2, 2), ("X", "Constant", 3, 3), ("m!", "Method", 4, 7), ("@c", "Variable", 5, 5), ("d", "Variable", 6, 6)]),
    "python": ("X = 1\nf = lambda a: a\nclass A:\n    def m(self):\n        y = 2\n", [("X", "Constant", 1, 1), ("f", "Function", 2, 2), ("A", "Class", 3, 5), ("m", "Method", 4, 5), ("y", "Variable", 5, 5)]),
}


@pytest.mark.parametrize("language", CASES)
def test_definitions_of_each_language(language):
    text, want = CASES[language]
    assert [row[:4] for row in symbols_of(text, language)] == want


def test_empty_and_unknown():
    assert symbols_of("", "rust") == [] and symbols_of("x", "text") == [] and symbols_of("", "vue") == []
