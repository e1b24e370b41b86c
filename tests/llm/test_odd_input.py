"""Every operator on odd tables: nulls anywhere, empty and very long texts, repeated rows, clashing columns."""

import pytest

from sitelens.llm import decontaminate, fingerprint, langid, language_model, line_dedup, packing, pii, secret_scan, simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHES = ["id", "text_", "word", "fp", "length", "bucket", "place", "guest", "host", "k", "n", "bad", "row", "score", "entity", "component", "component_id", "rank", "y", "order", "used"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 5000}x" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat with the dog", "en", "a"), (1, "the cat sat on the mat with the dog", "en", "a"), (2, None, None, None), (3, "", "de", None), (None, "kein hund und keine katze", "de", "a"),
        (None, None, None, None), (5, long, "en", "b"), (6, long, None, "b"), (7, " \n\t ", "fr", "b"), (8, "\U0001f600 é x", None, ""), (-9, "a" * 200_000, "en", "b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])


def test_rows_in_rows_out(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, "the cat sat on the mat with the dog"), (None, "kein hund"), (2, None)], "item_id long, text string").selectExpr("*", "1 AS item", "2 AS n")
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    found = decontaminate.judged(decontaminate.search(odd, bench))
    assert found.count() == n and found.filter("contaminated").count() == 2
    assert langid.identify(odd).count() == n
    assert toxicity.score(odd, labels).count() == n
    assert language_model.score(odd).count() == n
    assert secret_scan.digest(secret_scan.scan(odd)).count() == n
    assert fingerprint.fingerprints(odd).count() == n
    near = simhash.near_duplicates(odd)
    assert near.count() == n and near.filter("doc_id = 6").first()["component_id"] == 5
    pieces = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.filter("piece = 0").count() == n


def test_filters_keep_columns(spark, odd):
    bench = spark.createDataFrame([(1, "the cat sat on the mat with the dog")], "item_id long, text string")
    kept = {
        "accept": langid.accept(odd), "boilerplate": line_dedup.drop_boilerplate(odd), "one": simhash.keep_one(odd), "clean": decontaminate.drop_contaminated(odd, bench),
    }
    for name, frame in kept.items():
        assert frame.columns == odd.columns, name
    assert kept["boilerplate"].count() == odd.count() and kept["clean"].count() == odd.count() - 2
    hidden = pii.pseudonymise(odd, "k")
    assert hidden.count() == odd.count() and hidden.columns == [*odd.columns, "n_entities"]


def test_models_of_tables_without_rows(spark, odd):
    none = odd.limit(0)
    assert toxicity.score(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert language_model.score(none).count() == 0 and langid.accept(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_tables_without_rows(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([(1, "the cat sat on the mat with the dog")], "item_id long, text string")
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0 and fingerprint.fingerprints(none).count() == 0
    assert line_dedup.drop_boilerplate(none).columns == odd.columns and line_dedup.drop_boilerplate(none).count() == 0
    assert decontaminate.drop_contaminated(none, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert pii.pseudonymise(none, "k").count() == 0 and secret_scan.scan(none).count() == 0 and langid.identify(none).count() == 0


def test_values_on_odd_rows(spark, odd):
    """Not only as many rows, but the values that the docstrings tell."""
    bench = spark.createDataFrame([(1, "the cat sat on the mat with the dog"), (2, "kein hund")], "item_id long, text string")
    told = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judged(decontaminate.search(odd, bench)).collect()}
    assert {(1, 9, 9, 1, True), (None, 5, 2, 1, True), (None, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (7, 0, 0, 0, False), (-9, 1, 0, 0, False)} <= told
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.count() == odd.count() - 3 and left.filter("doc_id = 1").count() == 0
    pages = {r.doc_id: r for r in line_dedup.drop_boilerplate(odd, counted=True).filter("doc_id > 1").collect()}
    assert pages[2].text is None and pages[2].n_lines == 0 and pages[3].text == "" and pages[3].n_lines == 1
    marked = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).filter("doc_id IN (2, 3, 7)").collect()}
    assert {(i, p) for i, p, _ in marked} == {(2, "und"), (3, "und"), (7, "und")}
    near = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).filter("doc_id IN (2, 3, 7)").collect()}
    assert near == {i: ("0" * 16, 2) for i in (2, 3, 7)}
    hidden = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymise(odd, "k").filter("doc_id IN (2, 3)").collect()}
    assert hidden == {2: (None, 0), 3: ("", 0)}
