"""Nested type arguments: the extractor's rows and the operator over a column of type texts."""

import pytest

from strataloom.artifact.schema import TABLES
from strataloom.extract.engine import extract_file
from strataloom.operators import generics


def tree(fam, usage):
    """(type, [arguments]) of a usage, rebuilt from the parent links."""
    rows = [r for r in fam["type_arguments"] if r["usage_id"] == usage]

    def under(parent):
        level = [r for r in rows if r.get("parent_type_argument_id") == parent]
        assert [r["ordinal"] for r in level] == list(range(len(level)))
        return [(r["type_name"], under(r["type_argument_id"])) for r in level]

    return under(None)


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("java", "class A {\n  Map<String, List<User>> m;\n}\n", [[("String", []), ("List", [("User", [])])]]),
        ("java", "class A {\n  Object m = new Map<String, Map<K, List<V>>>();\n}\n", [[("String", []), ("Map", [("K", []), ("List", [("V", [])])])]]),
        ("java", "class Box<T extends B> extends Base<T[], ? super C> {}\n", [[("T[]", []), ("? super C", [])]]),
        ("typescript", "const f: Map<string, (a: A, b: B) => void> = x;\n", [[("string", []), ("(a: A, b: B) => void", [])]]),
        ("typescript", "let x: Map<string, { a: number; b: string }>;\n", [[("string", []), ("{ a: number; b: string }", [])]]),
        ("rust", "fn f(x: Ref<'a, Vec<u8>>) -> Result<HashMap<String, u8>, E> {\n}\n", [[("Vec", [("u8", [])])], [("HashMap", [("String", []), ("u8", [])]), ("E", [])]]),
        ("rust", "fn f() { let x = Vec::<Option<u8>>::new(); }\n", [[("Option", [("u8", [])])]]),
        ("python", "def f(x: Dict[str, List[int]], y=A[0]) -> Optional[User]:\n    z = {'k': Table[i:j]}\n", [[("str", []), ("List", [("int", [])])], [("User", [])]]),
        ("go", "package p\nfunc f(x Map[string, List[*User]]) Set[int] {\n\treturn Names[i]\n}\n", [[("string", []), ("List", [("*User", [])])], [("int", [])]]),
        ("scala", "class A {\n  val m: Map[String, Seq[Int]] = x\n}\n", [[("String", []), ("Seq", [("Int", [])])]]),
        ("java", "class A { boolean f(int N, int c) { return N<3 && c>2; } }\n", []),
        ("typescript", f"let x: Map<{'L' * 300}, B>;\n", [[("L" * 300, []), ("B", [])]]),
    ],
)
def test_extracted(language, text, want):
    fam = extract_file("f", language, text)
    assert [tree(fam, u["usage_id"]) for u in fam["type_argument_usages"]] == want
    assert all(set(r) <= set(TABLES["type_arguments"].names) for r in fam["type_arguments"])
    assert {u["identifier_id"] for u in fam["type_argument_usages"]} <= {i["identifier_id"] for i in fam["identifiers"]}


def test_flatten(spark):
    df = spark.createDataFrame([(1, "Map<String, List<User>>"), (2, "int"), (3, None), (4, " "), (5, "A<B<C<D>>, E>")], "k long, type string")
    got = [tuple(r) for r in generics.flatten(df, "type").drop("type").collect()]
    assert got == [
        (1, "", "0", 0, "Map"), (1, "0", "0.0", 0, "String"), (1, "0", "0.1", 1, "List"), (1, "0.1", "0.1.0", 0, "User"), (2, "", "0", 0, "int"),
        (5, "", "0", 0, "A"), (5, "0", "0.0", 0, "B"), (5, "0.0", "0.0.0", 0, "C"), (5, "0.0.0", "0.0.0.0", 0, "D"), (5, "0", "0.1", 1, "E"),
    ]


def test_deep_and_damaged():
    deep = "A<" * 5000 + "x" + ">" * 5000
    assert len(generics.flatten_type(deep)) == 5001
    for text in ("A<" * 5000, "A<B, " * 3000, ">" * 999, "f(A<)" * 999, "{<}(" * 999):
        generics.Brackets(text, "java")
