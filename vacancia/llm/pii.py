"""Personal data: exact patterns of four kinds, and a character-level BiLSTM-CRF that adds what the patterns don't cover.

The tagger is trained in numpy, in one task, from labelled spans: passages of a bounded sample of documents (SAMPLE_DOCS,
the smallest hashes of doc_id; of a longer one a stretch at a hashed place) into which generated values of each kind are set, in
many layouts (addresses with "[at]" and "(dot)", numbers with marks between parts, national phone numbers, cards of 15 digits),
and look-alikes (dates, versions, prices, identifiers, plain words with "at" and "dot"). Overlapping windows are cut around
digits, "@" and what stands for it in every whole text (stretches without are never read by the tagger, and hold no span of
these kinds). To the tagger all brackets are one. Windows are decoded by Viterbi, and where they overlap a character takes its
label from the window in which it stands furthest from an edge.

A span found so is completed (the characters that go on, the whole address around its sign, the run of digits that it is in)
and added if it then has the form of its kind (an address once "at" and "dot" are signs, four parts up to 255, Luhn's sum of a
card, the digits of a phone number) and touches no span of a pattern. Pattern spans always stay. A window's labels depend on its
characters alone (recurrences and paths end with the window, not with the batch), so the spans of a text don't depend on the
rows around it or on the partitioning.

Very long texts are read whole. Offsets are code points, end exclusive. Nulls count as empty texts; repeated rows and null doc_ids are reported like others.
An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage, tagger

#: Fixed order of the kinds.
KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARS, EXAMPLES, EXAMPLE_CHARS = 200, 2000, 3600, 80
#: Windows: characters kept on both sides of a digit or "@", length, and step from one to the next in a longer stretch.
CONTEXT, WINDOW, STEP = 24, 96, 64
#: Windows decoded at once.
BATCH = 512

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"(?i)(?:[0-9@]|[\[({<] ?at ?[\])}>]|\bat [\w-]{1,40} dot\b)(?:[^\n]{0,24}(?:[0-9@]|[\[({<] ?dot ?[\])}>]| dot [a-z]))*")
_MODELS: dict[bytes, dict[str, np.ndarray]] = {}
_SCHEMA = "doc_id bigint, base array<struct<kind: string, start: int, end: int>>, added array<struct<kind: string, start: int, end: int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from left to right, in linear time: by their "@"."""
    begin = at = 0
    while (at := text.find("@", at)) >= 0:
        local = len(text[begin:at]) - len(text[begin:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        begin = at = at + 1
        if domain:
            yield at - 1 - local, domain.end()
            begin = at = domain.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), in the order of the kinds, then by start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[:4]) <= 255 if len(p) < 4 else int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


# Training ------------------------------------------------------------------------------------------------------------


def _value(rng: random.Random) -> tuple[str | None, str]:
    """A kind and a value of it in one of many layouts; None for a look-alike."""
    n = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    kind = rng.choice(["email", "email", "ip", "card", "card", "phone", "phone", "phone", None, None, None, None])
    if kind == "email":
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}{n(2)}", f"{word()}.{n(2)}", f"{word()}_{word()}"])
        site, end = f"{word()}{rng.choice(['', '', n(1)])}", rng.choice(["com", "org", "net", "de", "io", "co.uk", "example.com"])
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", " . "), ("@", " . "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" at ", " dot "), (" AT ", " DOT "), ("[@]", "."), (" (@) ", ".")])
        return kind, f"{local}{at}{site}{dot}{end.replace('.', dot)}"
    if kind == "ip":
        return kind, rng.choice([".", ".", "[.]", " . ", "(.)", "[dot]", " dot "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        size = rng.choice([16, 16, 16, 15])
        body = (rng.choice("3456") if size == 16 else "3") + n(size - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        cuts = [body[i : i + 4] for i in range(0, 16, 4)] if size == 16 else [body[:4], body[4:10], body[10:]]
        return kind, rng.choice(["", " ", "-", ".", "  ", "_", " - "]).join(cuts)
    if kind == "phone":
        a, b, c, k = str(rng.randint(2, 9)) + n(2), n(3), n(4), str(rng.randint(20, 99))
        return kind, rng.choice([
            f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{k} {a} {b}{c}", f"1-{a}-{b}-{c}", f"00{k} {a} {b}{c}", f"00{k}-{a}-{b}-{c}",
            f"0{a} {b}{c}", f"0{a}/{b}{c}", f"0{a} {b} {c}", f"(0{a}) {b}{c}", f"+{k} (0){a} {b}{c}", f"0{a[:2]} {b[:2]} {c[:2]} {c[2:]} {n(2)}", f"0{a}-{b}{c}", f"1 ({a}) {b}-{c}", f"{a}/{b}-{c}",
        ])
    return None, rng.choice([
        f"{rng.randint(1900, 2030)}-{n(2)}-{n(2)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{n(2)}/{n(2)}/{rng.randint(1990, 2030)}", f"v{n(1)}.{n(1)}.{n(2)}", f"${n(3)}.{n(2)}", f"{n(1)},{n(3)}", f"{n(1)} {n(3)} {n(3)}", n(rng.randint(1, 6)),
        f"id {n(12)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{n(2)}:{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"§ {n(2)}.{n(1)}", f"@{word()}", f"{n(2)} %", f"{n(3)}-{n(2)}", f"ISBN {n(3)}-{n(1)}-{n(5)}", f"{n(2)} x {n(2)}", f"{word()} at {word()}",
        f"{word()} at {word()} dot", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"no. {n(5)}/{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{word()}@{word()}", f"{n(4)} {word()} {n(3)}", f"({n(2)})", f"[{n(1)}]", f"{n(3)}.{n(3)}", n(rng.randint(7, 20)), f"{word()}.{word()}",
    ])


#: All brackets are one to the tagger.
_FOLD = str.maketrans("[{<]}>", "((()))")


def _ids(text: str) -> np.ndarray:
    return tagger.char_ids(text.translate(_FOLD))


def examples(texts: list[str], count: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(passage, labelled spans)."""
    rng, out = random.Random(seed), []
    texts = [t for t in texts if len(t) > 40] or ["the quick brown fox jumps over the lazy dog and runs away, again. "]
    for _ in range(count):
        t = rng.choice(texts)
        at = rng.randrange(max(1, len(t) - 60))
        left, right = re.sub(r"[0-9@]", "", t[at : at + rng.randint(0, 20)]), re.sub(r"[0-9@]", "", t[at + 20 : at + 20 + rng.randint(0, 24)])
        kind, value = _value(rng)
        left += rng.choice([" ", " ", " ", ": ", "", "\n", "### "]) if left else ""
        right = (rng.choice([" ", " ", " ", ". ", ", ", "\n", "###", "%%% "]) + right) if right else ""
        out.append((f"{left}{value}{right}", [(kind, len(left), len(left) + len(value))] if kind else []))
    return out


def arrays(data: list[tuple[str, list[tuple[str, int, int]]]], width: int = EXAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character ids, labels (0: none; odd: first character of a kind; even: further ones) and mask."""
    x, y, mask = np.zeros((len(data), width), np.int64), np.zeros((len(data), width), np.int64), np.zeros((len(data), width), bool)
    for i, (text, spans) in enumerate(data):
        ids = _ids(text)[:width]
        x[i, : len(ids)], mask[i, : len(ids)] = ids, True
        for kind, a, b in spans:
            k = 2 * KINDS.index(kind)
            y[i, a:b] = k + 2
            y[i, a : a + 1] = k + 1
    return x, y, mask


def train(docs: DataFrame) -> bytes:
    """The model, from a bounded sample of documents, fitted in one task."""
    sample = storage.hashed_sample(docs, "doc_id", SAMPLE_DOCS).where(F.length("text") > 40)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    sample = sample.select(F.substring("text", at + 1, F.lit(SAMPLE_CHARS)).alias("text"))
    texts = sorted(r["text"] for r in sample.collect())  # bounded: only carriers for generated values

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            model = tagger.fit(*arrays(examples(texts)), labels=2 * len(KINDS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([tagger.dump(model)], pa.binary())], names=["model"])

    return bytes(docs.sparkSession.range(1).coalesce(1).mapInArrow(fit, "model binary").first()["model"])


# Tagging -------------------------------------------------------------------------------------------------------------


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows that hold every digit and "@" of the text with CONTEXT characters around it."""
    out = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a += STEP
        out.append((a, b))
    return out


def model_spans(texts: list[str], model: dict[str, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by the tagger, its windows reconciled."""
    cut = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    for at in range(0, len(cut), BATCH):
        own = cut[at : at + BATCH]
        x = np.zeros((len(own), max(b - a for _, a, b in own)), np.int64)
        mask = np.zeros(x.shape, bool)
        for row, (i, a, b) in enumerate(own):
            x[row, : b - a], mask[row, : b - a] = _ids(texts[i][a:b]), True
        for (i, a, b), labels in zip(own, tagger.decode(model, x, mask).tolist(), strict=True):
            for k in range(b - a):
                edge = min(k if a else WINDOW, b - a - 1 - k if b < len(texts[i]) else WINDOW)
                if (a + k) not in best[i] or best[i][a + k][0] < edge:
                    best[i][a + k] = (edge, labels[k])
    out = []
    for labels in best:
        spans: list[tuple[str, int, int]] = []
        for at in sorted(labels):
            label = labels[at][1]
            if label == 0:
                continue
            kind = KINDS[(label - 1) // 2]
            if label % 2 == 0 and spans and spans[-1][0] == kind and spans[-1][2] == at:
                spans[-1] = (kind, spans[-1][1], at + 1)
            else:
                spans.append((kind, at, at + 1))
        out.append(spans)
    return out


#: How addresses are written where they shall not be read by machines: what stands for "@" and for ".".
_AT = re.compile(r"(?i)\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*")
_DOT = re.compile(r"(?i)\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|[ \t]+\.[ \t]+|\.")
#: The characters that the number kinds and addresses go on with, where the tagger saw a part.
_GOES_ON = {"email": re.compile(r"[\w.%+-]"), "ip": re.compile(r"[0-9]"), "card": re.compile(r"[0-9]"), "phone": re.compile(r"[0-9()+]")}


def plain(kind: str, text: str) -> str:
    """A value as it is usually written."""
    return _DOT.sub(".", _AT.sub("@", text) if kind == "email" else text)


def plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain(kind, text)) is not None
    if kind == "ip":
        value = plain(kind, text)
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value) is not None and all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        least = 15 if digits == text else 14  # shorter ones only where marks part them
        return least <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ ._/-]{0,3}[0-9])*", text) is not None
    return 9 <= len(digits) <= 15 and (_NATIONAL.fullmatch(text) is not None or _DIALLED.fullmatch(text) is not None) and text.count("(") == text.count(")")


#: Phone numbers of ten digits with marks between them, and others that begin as they are dialled, with 0, + or a bracket.
_NATIONAL = re.compile(r"(?:1[ ./-]{0,2})?(?:\([2-9][0-9]{2}\)[ ./-]{0,2}|[2-9][0-9]{2}[ ./-]{1,2})[0-9]{3}[ ./-]{1,2}[0-9]{4}")
_DIALLED = re.compile(r"(?:\+|0|\(0)[0-9 ./-]{0,5}(?:\(?[0-9]{1,5}\)?)?(?:[ ./-]{0,3}[0-9]){4,12}")


#: A run of digits with the marks that numbers are written with.
_RUN = re.compile(r"\+?\(?[0-9](?:[ ().\[\]{}_/-]{0,3}[0-9])*")
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+(?:{_AT.pattern})[A-Za-z0-9-]+(?:(?:{_DOT.pattern})[A-Za-z0-9-]+)+".replace("(?i)", ""), re.IGNORECASE)


def _candidates(kind: str, text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    """What a span of the tagger may stand for, the likeliest first: a whole card number, the span itself, the run that it is in."""
    a, b = completed(kind, text, a, b)
    if kind == "email":
        low, high = max(0, a - 2 * CONTEXT), min(len(text), b + 2 * CONTEXT)
        a, b = next((m.span() for m in _ADDRESS.finditer(text, low, high) if m.start() < b and m.end() > a), (a, b))
    run = None
    if kind in ("card", "phone"):
        low = max(0, a - 2 * CONTEXT)
        run = next(((m.start(), m.end()) for m in _RUN.finditer(text, low, min(len(text), b + 2 * CONTEXT)) if m.start() < b and m.end() > a), None)
        if run:
            yield "card", *completed("card", text, *run)
    yield kind, a, b
    if run:
        yield "phone", *completed("phone", text, *run)


def completed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span with the characters that go on at both ends, without blanks and marks there."""
    more = _GOES_ON[kind]
    while a > 0 and more.match(text[a - 1]):
        a -= 1
    while b < len(text) and more.match(text[b]):
        b += 1
    while a < b and text[a] in " .,;:-/_[]{}<>" + (")" if kind == "phone" else "()"):
        a += 1
    while b > a and text[b - 1] in " .,;:-/_[]{}<>(" + ("" if kind == "phone" else ")"):
        b -= 1
    return a, b


def find(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, base (pattern spans), added (the tagger's): kind, start, end."""
    storage.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    data = train(docs) if model is None else model

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield tag(part, data)

    return docs.mapInArrow(scan, _SCHEMA)


def additions(text: str, known: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the tagger's spans, completed, those that have the form of their kind and touch no span of a pattern, nor each other."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in spans:
        for k, c, d in _candidates(kind, text, a, b):
            if plausible(k, text[c:d]):
                if not any(e < d and c < f for _, e, f in (*known, *out)):
                    out.append((k, c, d))
                break
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def tag(batch: pa.RecordBatch, data: bytes) -> pa.RecordBatch:
    if data not in _MODELS:
        _MODELS.clear()
        _MODELS[data] = tagger.load(data)
    texts = [t or "" for t in batch.column(1).to_pylist()]
    base = [base_spans(t) for t in texts]
    added = []
    for text, known, spans in zip(texts, base, model_spans(texts, _MODELS[data]), strict=True):
        added.append(additions(text, known, spans))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in rows], span)
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), listed(base), listed(added)], names=["doc_id", "base", "added"])


def digest(found: DataFrame) -> DataFrame:
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    every = F.transform(F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x.alias("span")))), lambda x: x["span"])
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind
