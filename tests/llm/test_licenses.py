import re

from millrace.llm import licenses, queries


def toks(t):
    return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]


def shingles(t):
    w = toks(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_query_against_exact_containment(spark, sf_dir, docs):
    """Whole notices: what is retrieved is all that contains four fifths of a template."""
    got = {(r.doc_id, r.template_id) for r in queries.op1_license_scan(spark, sf_dir).collect()}
    t = [shingles(x[1]) for x in licenses.TEMPLATES]
    want = {(r.doc_id, i) for r in docs.collect() for i in range(len(t)) if len(t[i] & shingles(r.text)) >= 0.8 * len(t[i])}
    assert got == want


def test_places_edits_and_blocks(spark, monkeypatch):
    mit = licenses.TEMPLATES[2][1]
    edited = mit.replace("sublicense", "resell", 1)
    filler = " ".join(f"w{i}" for i in range(37))
    docs = spark.createDataFrame([
        (1, f"{filler} {mit} {filler}"), (2, f"{edited}"), (3, filler), (4, None), (5, "MIT"), (6, mit[: len(mit) // 3]),
        (7, f"{filler}\n\nReleased  under the MIT License!"),
    ], "doc_id long, text string")
    rows = licenses.scan(docs, licenses.templates(spark)).collect()
    assert {(r.doc_id, r.template_id) for r in rows} == {(1, 2), (2, 2), (7, 0)}
    by = {r.doc_id: r for r in rows}
    assert by[1].containment == 1 and by[1].first_word == 37 and 0.8 <= by[2].containment < 1
    assert by[2].containment == len(shingles(mit) & shingles(edited)) / len(shingles(mit))
    monkeypatch.setattr(licenses, "BLOCK_KEYS", 100)
    assert sorted(map(tuple, licenses.scan(docs, licenses.templates(spark)).collect())) == sorted(map(tuple, rows))


def test_single_shingle_templates_are_retrieved_as_often_as_stated(spark):
    """2,000 places of a five-word template at random offsets: 0.99 of them at least, but for chance."""
    docs = spark.createDataFrame([(i, " ".join(f"a{i}x{j}" for j in range(i % 9)) + " licensed under some odd terms " + " ".join(f"b{i}x{j}" for j in range(8))) for i in range(2000)], "doc_id long, text string")
    t = spark.createDataFrame([(1, "ODD", "Licensed under some odd terms")], "template_id long, license string, text string")
    assert licenses.scan(docs, t).count() >= 0.98 * 2000


def test_odd_rows_and_empty_tables(spark, odd, empty):
    t = licenses.templates(spark)
    assert licenses.scan(odd, t).count() == 0
    assert licenses.scan(empty, t).count() == 0
    assert licenses.scan(odd, t.limit(0)).count() == 0
    own = spark.createDataFrame([(1, "X", "same row same id it comes twice"), (2, "Y", None), (3, "Z", "too short")], "template_id long, license string, text string")
    assert sorted(r.doc_id for r in licenses.scan(odd, own).collect()) == [7, 8]
