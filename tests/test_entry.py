import ast
import pathlib

import __spark_entry__ as entry_module

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry_module.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    for path in [*ROOT.glob("querl/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
