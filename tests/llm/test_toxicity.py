"""The grammar against the five transducers one after the other, clauses by hand, learned stems, held-out accuracy, odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from vacancia.llm import toxicity, transducers

SCHEMA = "doc_id bigint, text string, score string, CLAUSES string, toxic string, symbol string"


def patterns(text, lexicon=None):
    return [(text[a:b], p) for a, b, p, _ in toxicity.Reader(lexicon or toxicity.Lexicon()).clauses(text)]


def test_clauses_are_told_apart():
    assert patterns("You are an idiot. What a loser!") == [("You are an idiot", "directed insult"), ("What a loser", "insult")]
    assert patterns("He is not an idiot, and nobody here is a moron.") == [("He is not an idiot", "negated"), ("and nobody here is a moron", "negated")]
    assert patterns("Not one two three four five idiot.") == [("Not one two three four five idiot", "insult")]  # out of reach
    assert patterns("She said they are losers. Losers.") == [("She said they are losers", "reported"), ("Losers", "insult")]
    assert patterns('"You are stupid" was on the wall. “Scum”? You scum') == [('"You are stupid" was on the wall', "reported"), ("“Scum”", "reported"), ("You scum", "directed insult")]
    assert patterns('an open " idiot\n\nan idiot') == [('an open " idiot', "reported"), ("an idiot", "insult")]  # quotes end with the paragraph
    assert patterns("I will kill you, idiot. Murder!") == [("I will kill you", "directed threat"), ("idiot", "insult"), ("Murder", "threat")]
    assert patterns("IDI0T stüpid Du bist ein TROTTEL") == [("IDI0T stüpid Du bist ein TROTTEL", "directed insult")]
    assert patterns("\n\n") == patterns("") == patterns(None) == patterns("a quiet day, nothing more.") == []


def test_composition_equals_one_transducer_after_the_other():
    symbols = [*transducers.WORDS, *transducers.MARKS, *transducers.ENDS]
    parts = [transducers.negation(symbols)]
    for part in (transducers.reported, transducers.target, lambda s: transducers.strongest(s, "I"), lambda s: transducers.strongest(s, "T")):
        parts.append(part(sorted({out for row in parts[-1].arcs for _, out in row.values()})))
    whole, rng = transducers.grammar(), random.Random(2)
    tapes = [list(t) for t in itertools.product("IYNRQ|", repeat=4)] + [[rng.choice(symbols) for _ in range(30)] for _ in range(500)]
    for tape in tapes:
        tape, expected = [*tape, "P"], [*tape, "P"]
        for part in parts:
            expected = part(expected)
        got = [s for s, end in zip(whole(tape), tape, strict=True) if end in "|P"]
        assert got == [transducers.pattern_of(s) or "" for s, end in zip(expected, tape, strict=True) if end in "|P"]


def rows(n, seed, stem="zorqu"):
    """Documents of made-up words; a tenth holds words of one stem, some quote an insult, some deny one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), stem + rng.choice(words) if rng.random() < 0.7 else "moron")
        text = " ".join(text) + "."
        if not toxic and rng.random() < 0.1:
            text += rng.choice([' He said "you are an idiot".', " It is not an idiot.", " They wrote of an idiot."])
        out.append((i, text, int(toxic)))
    return out


def test_stems_are_learned_and_held_out_documents_are_told_apart(spark):
    found = rows(1500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in found], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in found], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    assert "zorqu" in model.lexicon.insults and "moron " in model.lexicon.insults
    assert sum(s not in ("zorqu",) and s.strip() not in toxicity.INSULTS for s in model.lexicon.insults) <= 2
    assert model.coefficients["insult"] > model.coefficients["reported"]
    toxic = {i: y for i, _, y in found}
    held = [r for r in toxicity.digest(toxicity.score(docs, model)).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held) and len(held) > 200
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.98
    again = toxicity.learn(docs.repartition(2), labels.union(labels))
    assert again.lexicon == model.lexicon and np.allclose(list(again.coefficients.values()), list(model.coefficients.values()))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert toxicity.learn(docs, flipped) == model  # labels of the held-out fold are never read


def test_stem_counts_equal_plain_counts(spark):
    found = [(t, y) for _, t, y in rows(60, 8)] + [(None, 0), ("", 1)]
    got = {r["stem"]: (r["n"], r["t"]) for r in toxicity.counted_stems(spark.createDataFrame(found, "text string, toxic int").repartition(4)).collect()}
    plain = {}
    for text, toxic in found:
        for stem in {s for w in (text or "").replace(".", " ").replace('"', " ").lower().split() for s in toxicity.stems_of(w)}:
            n, t = plain.get(stem, (0, 0))
            plain[stem] = (n + 1, t + toxic)
    assert got == {k: v for k, v in plain.items() if v[0] >= toxicity.LEAST_DOCS}


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows_get_defined_scores(spark, labelled):
    odd = [(1, None), (2, ""), (3, " \n\n "), (None, "you idiot"), (7, "you idiot"), (7, "a quiet day"), (8, "word " * 50_000 + "you moron"), (9, "quiet")]
    docs = spark.createDataFrame([(i, t, "s", "c", "1", "x") for i, t in odd], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 0), (7, 1), (7, 0), (1000, 1)] if labelled else [], "doc_id bigint, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, labels))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "toxic", "symbol", "score", "clauses"] and len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {(r["doc_id"], r["text"]): r["score"] for r in got}
    assert by[1, None] == by[2, ""] == by[3, " \n\n "] < by[7, "you idiot"] == by[None, "you idiot"] and by[7, "a quiet day"] == by[1, None]
    assert toxicity.digest(out).where("held_out is null or predicted is null").count() == 0
    assert [c["pattern"] for r in got for c in r["clauses"] if r["doc_id"] == 8] == ["directed insult"]
    nothing = spark.createDataFrame([], SCHEMA)
    assert toxicity.digest(toxicity.score(nothing, toxicity.learn(nothing, labels))).collect() == []
