"""Symbols with line ranges, their overlap with chunks, and chunks along them."""

import os
import textwrap
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.operators import symbols

rng = np.random.default_rng(9)


def found(code, language):
    return [(s.name, s.kind, s.start, s.end, s.parent) for s in symbols.read(textwrap.dedent(code).strip("\n"), language)]


def test_python():
    code = '''
    import os
    # def no(): pass
    class Greeter:
        """def not_this(): pass"""

        def greet(self, name="def x():"):
            return (name,
    "low")

        async def later(self):
            def inner():
                pass


    def hello():
        x = [
    1]
        return x

    y = 1
    '''
    assert found(code, "python") == [("Greeter", "class", 3, 12, None), ("greet", "function", 6, 8, "Greeter"), ("later", "function", 10, 12, "Greeter"), ("inner", "function", 11, 12, "later"), ("hello", "function", 15, 18, None)]


def test_typescript():
    code = """
    export function add(a: number, b: number): number {
      if (a > b) { return a }
      return a + b; // } not an end
    }
    const multiply = (a: number, b: number): number => {
      return a * b;
    };
    const half = x => x / 2;
    export class Calculator {
      private total = 0;
      subtract(a: number, b: number): number {
        for (let i = 0; i < 2; i++) { add(i, 1) }
        return a - b;
      }
      static async of(text = "}{"): Promise<Calculator> { return new Calculator(); }
    }
    """
    assert found(code, "typescript") == [("add", "function", 1, 4, None), ("multiply", "variable", 5, 7, None), ("half", "variable", 8, 8, None), ("Calculator", "class", 9, 16, None), ("subtract", "method", 11, 14, "Calculator"), ("of", "method", 15, 15, "Calculator")]


def test_csharp():
    code = """
    namespace TestNs
    {
        public interface IService { void Run(); }
        /// <summary>
        /// A simple calculator class.
        /// </summary>
        [Serializable]
        public class Service : IService
        {
            public Service(int x) { }
            public string Name { get; set; }
            public int Twice => 2;
            /// <summary>Adds two numbers.</summary>
            public int Add(int a, int b)
            {
                if (a > b) { return a; }
                return a + b;
            }
        }
        public enum Status { A, B }
        public struct Point { public int X; }
        public record Person(string Name);
    }
    """
    got = found(code, "csharp")
    assert [(n, k) for n, k, *_ in got] == [("TestNs", "namespace"), ("IService", "interface"), ("Run", "method"), ("Service", "class"), ("Service", "constructor"), ("Name", "property"), ("Twice", "property"), ("Add", "method"), ("Status", "enum"), ("Point", "struct"), ("Person", "record")]
    assert got[0][2:4] == (1, 23) and got[7][2:] == (14, 18, "Service") and got[3][2:4] == (8, 19)
    lines = textwrap.dedent(code).strip("\n").split("\n")
    assert symbols.doc_comment(lines, 8) == "A simple calculator class." and symbols.doc_comment(lines, 14) == "Adds two numbers." and symbols.doc_comment(lines, 20) is None


def test_java_and_go():
    java = """
    package a;
    @Service
    public class Cart extends Base {
        private int n = count(1);
        @Override
        public List<String> items(int k) throws IOException {
            while (k > 0) { k--; }
            return null;
        }
        abstract int size();
    }
    """
    assert found(java, "java") == [("Cart", "class", 3, 11, None), ("items", "method", 6, 9, "Cart"), ("size", "method", 10, 10, "Cart")]
    go = """
    package a
    type ID int
    type Point struct {
    	X int
    }
    func (p *Point) Move(dx int) error {
    	return func() error { return nil }()
    }
    func Add(a, b int) int {
    	return a + b
    }
    """
    assert found(go, "go") == [("ID", "type", 2, 2, None), ("Point", "type", 3, 5, None), ("Move", "method", 6, 8, None), ("Add", "function", 9, 11, None)]


def test_pascal():
    code = """
    unit Sample;
    interface
    type
      TCalc = class
        procedure Reset;
        function Add(a: Integer; b: Integer): Integer;
      end;
    implementation
    procedure TCalc.Reset;
    begin
      try
        x := 'end; begin';
      finally
      end;
    end;
    function TCalc.Add(a: Integer; b: Integer): Integer;
    begin
      case a of
        1: Result := b;
      end;
    end;
    end.
    """
    assert found(code, "pascal") == [("TCalc", "class", 4, 7, None), ("Reset", "declared", 5, 5, "TCalc"), ("Add", "declared", 6, 6, "TCalc"), ("TCalc.Reset", "function", 9, 15, None), ("TCalc.Add", "function", 16, 21, None)]


def test_awkward_texts():
    assert symbols.read("", "python") == [] and symbols.read("class A {", "cobol") == []
    for language in symbols.LANGUAGES:
        assert symbols.read("}}} ((( {{ \"open 'string", language) is not None
    deep = "class A {" * 3000 + "}" * 3000
    assert len(symbols.read(deep, "java")) == 3000


def brute(chunks, marks):
    out = {}
    for c, source, a, b in chunks:
        near = [(s < a, -s, e, name) for src, name, s, e in marks if src == source and s <= b and e >= a]
        out[c] = min(near)[3] if near else None
    return out


def test_overlap_against_all_pairs(spark):
    chunks = [(f"c{i}", f"f{i % 5}", int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(1, 900, 300), rng.integers(0, 200, 300), strict=True))]
    marks = [(f"f{i % 6}", f"s{i}", int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(1, 1000, 400), rng.integers(0, 400, 400), strict=True))]
    left = spark.createDataFrame(chunks, "chunk_id string, source string, start_line int, end_line int")
    right = spark.createDataFrame([(*m, "k") for m in marks], "source string, name string, start_line int, end_line int, kind string")
    out = symbols.overlapping(left, right)
    assert {r.chunk_id: r.symbol_name for r in out.collect()} == brute(chunks, marks)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("lines, chars", [(40, 1500), (10, 300), (4, 60)])
def test_chunks_are_bounded_and_whole(lines, chars):
    body = "".join(f"def f{i}(x):\n" + "".join(f"    x += {j} * {i}\n" for j in range(int(rng.integers(1, 30)))) + "\n" for i in range(30)) + "y = '" + "z" * 400 + "'\n"
    parts = symbols.packed(body, "python", lines, chars)
    assert all(len(t) <= chars and b - a < lines for a, b, t in parts)
    assert "".join("".join(t.split()) for _, _, t in parts) == "".join(body.split())
    if lines == 40:
        # functions that fit are not cut
        spans = [(s.start, s.end) for s in symbols.read(body, "python")]
        assert not [1 for s, e in spans for a, b, _ in parts if s < a <= e]


def test_tables(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n", "python"), ("b.txt", "One. Two.", "markdown"), ("c.py", None, "python"), ("d.py", "", "python")], "source string, text string, language string")
    assert [tuple(r)[:6] for r in symbols.symbols(files).collect()] == [("a.py", "f", "function", "function_definition", 1, 2)]
    made = {(r.source, r.start_line, r.end_line, r.text) for r in symbols.code_chunks(files).collect()}
    assert made == {("a.py", 1, 3, "def f():\n    pass\n"), ("b.txt", None, None, "One. Two.")}


def test_deep_blocks_are_packed_in_one_pass():
    deep = "class A {\n" * 20_000 + "}\n" * 20_000
    began = time.process_time()
    parts = symbols.packed(deep, "java")
    # 400 million steps if each symbol counted its own lines
    assert time.process_time() - began < 8
    assert "\n".join(t for _, _, t in parts).rstrip() == deep.rstrip() and all(b - a < 40 for a, b, _ in parts)


def test_statements_within_parentheses_and_types():
    code = "class A {\n int a(int x);\n int b(@N(1) int y) { for (;;) { f(y); } }\n abstract java.util.List<String> c (int z);\n int d = g(1);\n}\nrecord R(int a);\nvoid h(int a) { }\n"
    got = [(s.name, s.kind, s.start, s.end, s.parent) for s in symbols.read(code, "java")]
    assert got == [("A", "class", 1, 6, None), ("a", "method", 2, 2, "A"), ("b", "method", 3, 3, "A"), ("c", "method", 4, 4, "A"), ("R", "record", 7, 7, None), ("h", "function", 8, 8, None)]


def test_code_of_a_small_table_is_dealt_to_all_tasks(spark):
    from fathomry.plans import catalog

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    files = catalog._classes(spark, path, "p_size")
    full = files.groupBy(F.spark_partition_id()).count().count()
    assert full == 4 * spark.sparkContext.defaultParallelism
    assert files.count() == catalog._table(spark, path, "part").count()
