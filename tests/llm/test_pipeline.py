"""Each stage on the rows that the one before it kept, and the guard of the entry point."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from millrace.llm import perplexity, pii, simhash, tiling

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf_dir, docs, tmp_path):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    at, ids = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, sf_dir).write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        if name != "mix":
            assert at.columns == docs.columns
        got = sorted(r.doc_id for r in at.select("doc_id").collect()) if name != "mix" else None
        ids.append(got)
        if name == "quality_rules":
            assert got == sorted(r.doc_id for r in perplexity.assess(before).where("kept").collect())
        if name == "near_dedup":
            assert got == sorted({r.component_id for r in simhash.near_duplicates(before).collect()})
        if name == "decontaminate":
            leaked = {r.doc_id for r in tiling.contaminated(before, bench).collect()}
            assert leaked and got == sorted(set(ids[-2]) - leaked)
        if name == "pii":
            assert got == ids[-2] and sum(r.n_email + r.n_card + r.n_phone + r.n_ip for r in pii.digest(pii.find(at)).collect()) == 0
            assert at.where("n_chars <> length(text)").count() == 0
        if name == "mix":
            used = {d for r in at.collect() for d in r.doc_ids}
            assert used <= set(ids[-2]) and len(used) > 0.3 * len(ids[-2])


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, odd, empty):
    """Nulls in any column, blank and very long texts, repeated rows and clashing columns."""
    for table in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            rows = out.collect()
            if name != "mix":
                assert out.columns == table.columns
            if table is empty:
                assert not rows
            elif name in ("decontaminate", "pii"):
                same = lambda rs: sorted(str([x for x, c in zip(r, out.columns, strict=True) if c != "n_chars"]) for r in rs)
                assert same(rows) == same(odd.collect())  # nothing leaks or is personal here; n_chars is counted anew
            elif name == "near_dedup":
                assert sorted([r.doc_id for r in rows], key=str) == [1, 4, 5, 6, 7, 9, None]
            elif name == "quality_rules":
                assert {r.doc_id for r in rows} <= {4}
            else:
                assert sum(r.n_words for r in rows) > 0 and {d for r in rows for d in r.doc_ids} <= {r.doc_id for r in odd.collect()}


def test_run(spark, sf_dir):
    assert {"shard", "position", "source", "doc_ids", "text"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def test_entry_point_without_the_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; assert 'wordcount' in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
