import ast
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from lanternql.llm import common, decontaminate, mixing, quality_rules
from tests.llm import cases
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names and 4 <= len(pipeline.STAGES) <= 5


def test_stage_by_stage(spark, tmp_path):
    rows = cases.documents(90)
    bench = [(1, rows[7][1][:300]), (2, "not in any document at all but long enough to have some windows")]
    rows.append((2000, " ".join(["junk"] * 100), "en", "s1", 0))
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    names = docs.columns
    before = rows
    for (name, stage), number in zip(pipeline.STAGES, (2, 5, 1, 4, 6)):
        out, _ = common.materialized(stage(spark, docs, str(tmp_path)), "test-stage")
        got = [tuple(r) for r in out.collect()]
        if number != 6:
            assert out.columns == names
        if number == 2:
            keep = {str(r.doc_id) + str(r.n_words) for r in quality_rules.judge(docs).where("kept").collect()}
            assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in before if str(r[0]) + str(len((r[1] or "").encode().split())) in keep)
        elif number == 5:
            label = brute_components([(r[0], brute_fingerprint(r[1])) for r in before])
            assert sorted(r[0] for r in got if r[0] is not None) == sorted({i for i in label if i is not None})
        elif number == 1:
            leaks = {r.doc_id for r in decontaminate.find_leaks(docs, common.table(spark, str(tmp_path), "benchmark")).collect()}
            assert 7 in leaks and sorted(map(str, got)) == sorted(str(r) for r in before if r[0] not in leaks)
        elif number == 4:
            words = lambda rs: sum(len((r[1] or "").encode().split()) for r in rs)
            assert words(got) == sum(r[4] for r in brute_mix(before))
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in before]
            want = sorted((str(r[0]), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(before, ids))
            assert sorted((str(r[0]), r[2], r[3]) for r in got) == want
            ordered = sorted(got, key=lambda r: r[1])
            assert [r[1] for r in ordered] == [0, *np.cumsum([r[2] for r in ordered])[:-1].tolist()]
        docs, before = out, got
    assert mixing.SHARE == 1.5
    assert sorted(str(tuple(r)) for r in pipeline.run(spark, str(tmp_path)).collect()) == sorted(map(str, before))


def test_nothing_else_imports_llm():
    root = Path(pipeline.__file__).parent
    for p in [*root.glob("lanternql/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in p.parts and p.exists():
            for node in ast.walk(ast.parse(p.read_text())):
                if isinstance(node, ast.Import | ast.ImportFrom):
                    found = [a.name for a in node.names] + [getattr(node, "module", None) or ""]
                    assert not any("llm" in f.split(".") for f in found), p


def test_empty_tables(spark, tmp_path):
    tables = {
        "documents": cases.SCHEMA,
        "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    queries = entry.queries()
    for name in [n for n in queries if n.startswith("op") or n == "pipeline"]:
        assert queries[name](spark, str(tmp_path)).collect() == [], name
