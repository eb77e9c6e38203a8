import itertools
import re

import pytest

from sparkloom.llm import license_scan


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "BSD-redistribution"])
def test_notices_back_to_back(spark, name):
    """All copies count, however close they stand."""
    notice = license_scan.TEMPLATES[name]
    rows = [(1, notice + " " + notice), (2, "\n".join([notice] * 5)), (3, f"é start {notice} and {notice} end"), (4, " ".join([notice] * 300))]
    got = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, text), n in zip(rows, (2, 5, 2, 300), strict=True):
        own = sorted((r.start, r.end) for r in got if r.doc_id == i)
        assert len(own) == n and {r.license for r in got} == {name} and {r.coverage for r in got} == {1.0}
        assert all(text[a:b] == notice.rstrip(".:") for a, b in own)


def test_copies_among_edited_ones(spark):
    notice = license_scan.TEMPLATES["BSD-redistribution"]
    edited = notice.replace("source", "some").replace("without", "no")
    text = f"{notice} {edited} {notice}"
    got = license_scan.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [r.n_matched for r in got] == [21, 19, 21] and [r.coverage for r in got] == [1.0, 0.904762, 1.0]


@pytest.mark.parametrize("name", list(license_scan.TEMPLATES))
def test_edited_notices(name):
    """One word in ten replaced (one at least), as long as the coverage is reached: all short notices and nearly all long ones are found."""
    import random

    rng = random.Random(name)
    words = re.findall(r"[A-Za-z0-9]+", license_scan.TEMPLATES[name])
    index = license_scan.Index(license_scan.TEMPLATES)
    template = license_scan.template_words(license_scan.TEMPLATES[name]).tolist()
    found = 0
    for _ in range(60):
        own = list(words)
        for i in rng.sample(range(len(own)), max(1, len(own) // 10)):
            own[i] = f"zz{rng.randrange(9)}"
        text = ["x1", "x2", *own, "x3"]
        h = license_scan.template_words(" ".join(text))
        best = max((license_scan.aligned(h.tolist(), template, low - 8, high + 8)[0] for t, low, high in index.candidates(index.hits(h)) if index.names[t] == name), default=0)
        found += best >= license_scan.COVERAGE * len(words)
    assert found == 60 if len(words) < license_scan.SHORT else found >= 59


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "Apache-2.0"])
def test_any_words_may_be_missing(name):
    """Short notices keep a hit whichever words are replaced, dropped or have one before them."""
    words = re.findall(r"[A-Za-z0-9]+", license_scan.TEMPLATES[name])
    index = license_scan.Index(license_scan.TEMPLATES)
    missing = len(words) - -int(-license_scan.COVERAGE * len(words) // 1)
    for places in itertools.combinations(range(len(words)), missing):
        for how in (lambda w: [], lambda w: ["zz"], lambda w: ["zz", w]):
            own = [x for i, w in enumerate(words) for x in (how(w) if i in places else [w])]
            found = index.candidates(index.hits(license_scan.template_words(" ".join(own))))
            assert name in {index.names[t] for t, *_ in found}


def test_odd_rows_and_templates(spark, odd, none):
    own = {"one": "mail", "long": "a b c d e"}
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license, r.start, r.end) for r in license_scan.scanned(odd, own).collect())
    assert got == [(False, 1, "long", 0, 9), (False, 4, "long", 0, 9), (False, 4, "long", 0, 9), (False, 8, "one", 0, 4), (True, 0, "long", 0, 9)]
    assert license_scan.scanned(none).collect() == []
    with pytest.raises(ValueError, match="no words"):
        license_scan.Index({"x": "--"})
