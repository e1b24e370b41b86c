"""Whole names or none, further forms, and many surnames."""

import re

from pyspark.sql import functions as F

from sitelens.llm import pii


def hidden(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(rows, "k").orderBy("doc_id").collect()]


def test_names_of_every_form_go_whole(spark):
    texts = [
        "Mrs Smith-Jones met Mr Smith", "Ms McDonald", "Mr. John Q. Smith", "Mr O'Brien and O'Brien", "Dr Jane Doe", "Mrs Ann Lee saw ANN LEE and Lee", "Mr ANN LEE", "Prof. A. B. Curie", "Sir John", "Mr. Smith's", "Mr went", "Herr Müller-Lüdenscheidt",
    ]
    got = hidden(spark, texts)
    for real in ("Smith", "Jones", "McDonald", "Donald", "John", "Brien", "Jane", "Doe", "Ann", "Lee", "ANN", "LEE", "Curie", "Müller", "denscheidt"):
        assert not any(re.search(rf"\b{real}", t) for t in got), real
    assert re.fullmatch(r"Mrs \w+-\w+ met Mr \w+", got[0]) and got[0].split("-")[0].removeprefix("Mrs ") == got[0].split()[-1]
    assert re.fullmatch(r"Mr\. \w+ [A-PR-Z]\. \w+", got[2]) or re.fullmatch(r"Mr\. \w+ [A-Z]\. \w+", got[2])
    assert re.fullmatch(r"Mr O'(\w+) and O'\1", got[3]) and re.fullmatch(r"Dr \w+ \w+", got[4])
    first, _, _, loud, louder, _, last = got[5].removeprefix("Mrs ").split()
    assert (loud, louder, last) == (first.upper(), got[5].split()[2].upper(), got[5].split()[2]) and got[6].removeprefix("Mr ").isupper()
    assert re.fullmatch(r"Prof\. [A-Z]\. [A-Z]\. \w+", got[7]) and got[10] == "Mr went"
    assert hidden(spark, texts) == got


def test_national_phones_and_short_addresses(spark):
    got = hidden(spark, ["0171 1234567", "07700 900123.", "::1", "at 2001:db8:: and fe80::1", "std::1 12:30", "10 000 000", "page 0171"])
    assert re.fullmatch(r"\d{4} \d{7}", got[0]) and got[0] != "0171 1234567" and re.fullmatch(r"\d{5} \d{6}\.", got[1]) and got[1] != "07700 900123."
    assert re.fullmatch(r"::[0-9a-f]", got[2]) and re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}:: and fe80::[0-9a-f]", got[3])
    assert got[4:] == ["std::1 12:30", "10 000 000", "page 0171"]


def test_surnames_never_run_out(spark, monkeypatch):
    """More surnames than four syllables of two kinds give: later draws have more of them, and none is left to be numbered in one task."""
    monkeypatch.setattr(pii, "ranked", None)
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "co"] * 8)
    names = spark.range(60).select(F.concat(F.lit("Mr X"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij")).alias("entity"))
    monkeypatch.setattr(pii, "MAX_DRAWS", 8)
    over = pii.redrawn_entities(names, "k")
    new = names.join(over, "entity", "left").select("entity", F.coalesce("surrogate", pii.surrogate(F.col("entity"), "k")).alias("new"))
    assert new.select("new").distinct().count() == 60 and over.count() > 40 and any(len(r.new) > 16 for r in new.collect())
