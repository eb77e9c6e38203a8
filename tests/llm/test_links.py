import collections
import random

from sparkloom.llm import license_scan, linking, ngram_join, substring_dedup

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def clusters(sets, num, den):
    """Least key reachable by links, for each key of sets."""
    keys = sorted(sets)
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def grouped_texts(seed=5, groups=12, each=14, words=60):
    """Groups of copies with few to many edits, so that links hold only between some."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words + g)]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary).upper()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    want = clusters({n: frozenset(frozenset(p) for p in pairs if n in p and p[0] != p[1]) | {n} for n in nodes}, 0, 1)
    assert got == want


def test_ngram_join_matches_brute_force(spark, documents):
    texts = grouped_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for d in (docs, documents):
        sets = {r.doc_id: shingles(r.text, 3) for r in d.collect()}
        want = clusters(sets, 90, 100)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(d).collect()}
        assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_ngram_join_of_odd_rows(odd, none):
    out = ngram_join.joined(odd)
    assert out.count() == odd.count() and ngram_join.joined(none).count() == 0
    by = collections.defaultdict(set)
    for r in out.collect():
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(3, 1)} and by[4] == {(3, 1)} and by[3] == {(0, 3)} and by[2] == {(0, 2)}
    assert by[5] == {(1, 5)}
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 6, 7, 8, 9]


def test_representatives_of_unlike_texts_with_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    docs = spark.createDataFrame([(1, a, 0), (1, b, 1), (1, b, 2), (2, a, 3), (3, b + " end", 4), (4, c, 5), (None, a, 6)], "doc_id long, text string, join_key long")
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted([(1, a), (1, b), (4, c)])
    assert [r.text for r in kept.collect() if r.doc_id is None] == [a]


def paragraphs(rows, least=25):
    out = {}
    for doc_id, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            if len(line.encode().split()) >= least:
                out[doc_id, at] = (len(line), shingles(line, 5))
            at += len(line) + 1
    return out


def test_substring_dedup_matches_brute_force(spark):
    texts = grouped_texts(8, 10, 9, 70)
    rows = [(i, "\n".join([texts[i], f"short é line {i}", texts[-1 - i % 40], ""])) for i in range(len(texts) // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = paragraphs(rows)
    part = clusters({k: v[1] for k, v in own.items()}, 80, 100)
    sizes = collections.Counter(part.values())
    want = {(k[0], k[1], k[1] + own[k][0], part[k][0], part[k] != k) for k in own if sizes[part[k]] > 1}
    got = {(r.doc_id, r.start, r.end, r.first_doc_id, r.removed) for r in substring_dedup.repeated(docs, block=None).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    clean = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs, block=None).collect()}
    cut = collections.defaultdict(list)
    for i, s, e, _, removed in got:
        if removed:
            cut[i].append((s, e))
    for i, text in rows:
        for s, e in sorted(cut[i], reverse=True):
            text = text[:s] + text[e:]
        assert clean[i] == text


def test_substring_dedup_of_odd_rows(odd, none):
    assert substring_dedup.repeated(odd, block=None).count() == 0 and substring_dedup.spans(none).count() == 0
    own = odd.selectExpr("*", "1 AS cut_id", "2 AS cut_key", "3 AS cuts", "4 AS `start`")
    out = substring_dedup.deduplicated(own)
    assert out.columns == own.columns and out.count() == odd.count()
    long = {r.doc_id: (r.start, r.end, r.removed) for r in substring_dedup.spans(odd).collect()}
    assert set(long) == {5} and {r.doc_id for r in out.filter("length(text) > 100").collect()} <= {5}


def test_tuned_bands_reach_the_recall():
    bands, rows = substring_dedup.tuned(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= substring_dedup.RECALL > 1 - (1 - 0.8**rows) ** (bands - 1)


def whole_alignment(h, t):
    """Best local alignment without a band."""
    return license_scan.aligned(h, t, -len(t), len(h))


def test_license_scan(spark, documents):
    templates = license_scan.TEMPLATES
    mit = templates["MIT-permission"]
    rows = [(1, "Intro.\n" + templates["Apache-2.0"] + "\nmore"), (2, mit.replace("free of charge", "at no cost at all")), (3, "nothing here at all"), (4, None), (5, ""), (6, "é " + templates["GPL-3.0"].lower() + " x " + templates["MIT"]), (7, "licensed under the terms of some license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in license_scan.scanned(docs).collect()}
    assert set(got) == {(1, "Apache-2.0"), (2, "MIT-permission"), (6, "GPL-3.0"), (6, "MIT")}
    for (i, name), r in got.items():
        text = dict(rows)[i]
        if r.coverage == 1:
            assert text[r.start : r.end].strip(". ").lower() == templates[name].strip(". ").lower()
    assert 0.9 < got[2, "MIT-permission"].coverage < 1
    index = license_scan.Index(templates)
    for r in documents.collect():  # candidates and bands lose nothing that a whole alignment finds
        h = license_scan.template_words(r.text).tolist()
        whole = {index.names[t] for t, w in enumerate(index.words) if len(w) < 20 and whole_alignment(h, w.tolist())[0] == len(w)}
        found = {x.license for x in license_scan.scanned(documents.filter(documents.doc_id == r.doc_id)).collect()} if whole else set()
        assert whole <= found
