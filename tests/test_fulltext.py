"""The stored text index: stems, queries and ranks against plain versions, long texts, what a query reads."""

import random
import re
import time

import pytest

from vacancia.functions.stemmer import porter2
from vacancia.operators import fulltext
from vacancia.sources import stored

#: Words and stems of the published sample, and one word for each rule.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave
knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die generously generous communication communic arsenal arsenal ties tie cries cri gas gas gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri
relational relat conditional condit rational ration hopefulness hope controll control roll roll agreed agre feed feed proceed proceed inning inning bleed bleed sing sing
geology geolog replied repli adoption adopt abilities abil say say by by engineering engin pipelines pipelin c++ c++ k8s k8s""".split()


def test_stems_are_the_published_ones():
    assert {w: porter2(w) for w in SAMPLE[::2]} == dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))


def search(docs, query):
    return {r["doc_id"]: r["rank"] for r in fulltext.search(fulltext.postings(docs), query).collect()}


def test_words_phrases_alternatives(spark):
    docs = spark.createDataFrame([(1, "building data pipelines in Python"), (2, "data python"), (3, "pipelines of data"), (4, "cobol"), (5, None), (6, "state of the art")], "doc_id long, text string")
    ids = lambda q: set(search(docs, q))
    assert ids("data python") == {1, 2} and ids('"data pipelines"') == {1} and ids("data -python") == {3} and ids("cobol or pipeline") == {1, 3, 4} and ids("the") == set()
    assert ids("built piping") == set() and ids("builds") == {1} and ids('"state of the art"') == {6} and ids('"state art"') == set() and ids('"pipeline of datum" or "pipelined of data"') == {3}
    assert fulltext.matches_without_hits("-data") and not fulltext.matches_without_hits("data -python") and not fulltext.matches_without_hits("the")


def test_rank_by_cover_density(spark):
    docs = spark.createDataFrame([(1, "red widget and blue widget red"), (2, "widget"), (3, "red x y widget")], "doc_id int, text string")
    assert search(docs, "widget") == {1: 0.2, 2: 0.1, 3: 0.1}
    # Shortest stretches of both words in the first text: 0-1, 1... to the last red (4-5); in the third 0-3 with two words between.
    assert search(docs, "red widget") == {1: 0.2, 3: round(0.1 / 3, 6)}
    assert search(docs, "red -widget") == {} and set(search(docs, "blue or x")) == {1, 3}


def plain_rank(text, query):
    words = re.findall(r"[a-z0-9+#]+", (text or "").lower())
    at = lambda w: [i for i, x in enumerate(words) if x not in fulltext.STOP and porter2(x) == w]
    groups = fulltext.stemmed(query)
    fits = lambda g: all(any(all(p + i in at(w) for i, w in ws) for p in at(ws[0][1])) == yes for yes, ws in g)
    if not any(map(fits, groups)):
        return None
    total = 0.0
    for g in groups:
        own = sorted({w for yes, ws in g if yes for _, w in ws})
        every = sorted(p for w in own for p in at(w))
        stretches = {(a, b) for a in every for b in every if a <= b and all(any(a <= p <= b for p in at(w)) for w in own)}
        for a, b in stretches:
            if not any((c, d) != (a, b) and a <= c and d <= b for c, d in stretches):
                total += 0.1 / (1 + max(0, b - a - sum(a <= p <= b for p in every) + 1))
    return round(total, 6)


def test_index_equals_reading_all_texts(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = "engineer engineering engineers data pipeline pipelines of the red widget widgets go remote".split()
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    fulltext.save(docs, str(tmp_path / "index"))
    index = fulltext.load(spark, str(tmp_path / "index"))
    queries = ["engineering widgets", '"red widgets" data', "go -remote or pipelines engineer data", '"pipeline of the widget"', "data data", '"data engineers" or "go remote" -red', "widgets -engineer -data"]
    terms = sorted({t for q in queries for t in fulltext.terms_of(q)})
    got = {r["doc_id"]: r["ranks"] for r in fulltext.ranks(fulltext.hits(index, terms), queries).collect()}
    for i, text in texts:
        assert got.get(i, [None] * len(queries)) == [plain_rank(text, q) for q in queries], (i, text)
    counted = {r["term"]: r["documents"] for r in fulltext.frequencies(index, "engineers red").collect()}
    assert counted == {"engin": sum("engineer" in (t or "") for _, t in texts), "red": sum("red" in (t or "").split() for _, t in texts)}


def test_a_query_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 50} common") for i in range(400)], "doc_id long, text string")
    fulltext.save(docs, str(tmp_path / "index"))
    plan = fulltext.hits(fulltext.load(spark, str(tmp_path / "index")), ["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [" in plan and "common" in plan.split("PushedFilters")[1]
    assert fulltext.search(fulltext.load(spark, str(tmp_path / "index")), "commonly").count() == 400


def test_many_hits_in_one_text_rank_in_linear_time(spark):
    at = {"red": list(range(0, 300_000, 3)), "widget": list(range(1, 300_000, 3))}
    began = time.time()
    assert fulltext.rank(fulltext.stemmed('"red widgets" or red'), at) > 0
    assert time.time() - began < 2  # 200,000 hits
    docs = spark.createDataFrame([(1, "red widget and " * 100_000)], "doc_id int, text string")
    rows = fulltext.postings(docs).cache()
    assert rows.count() == 2
    search(spark.createDataFrame([(1, "x")], "doc_id int, text string"), "x")
    began = time.time()
    assert fulltext.search(rows, "red").first()["rank"] == pytest.approx(10_000.0)
    assert time.time() - began < 5


def test_what_is_stored_is_written_once(spark):
    calls = []
    build = lambda path: calls.append(path) or spark.range(3).write.parquet(path)
    assert stored.once(spark, "n", "a", build) == stored.once(spark, "n", "a", build) != stored.once(spark, "n", "b", build) and len(calls) == 2
