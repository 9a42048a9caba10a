"""Personal data against plain regular expressions, and disclosing terms against counting by hand."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.llm import disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a@.-_+0125 9()é\n4"), max_size=60))
def test_patterns(text):
    assert disclosure.personal_data(text) == plain(text)


def test_known_cases():
    text = "é x_y.z+1@a-b.co.uk,q@r.s@t.u 10.0.0.255.1.2.3.4 256.1.1.1, 4111 1111-1111 1111, 4111111111111112, +49 (30) 123.456-78 +1234"
    assert disclosure.personal_data(text) == plain(text) and len(plain(text)) >= 6
    assert disclosure.personal_data("a" * 200_000 + "@") == [] == disclosure.personal_data("1" * 100_000)  # no square of a run's length


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, some(rng.randint(5, 60))) for i in range(200)]
    for i in range(200, 206):  # a nickname that is met with one address alone, in contexts that differ
        out.append((i, f"{some(9)} Zorblax {some(2)} jo@ex.org {some(12)}"))
    out += [(206 + i, f"copied words of one passage near al@ex.org and more Quuxly {i % 1}") for i in range(6)]  # one context
    out += [(220, "Zorblax without the address"), (221, None), (222, ""), (223, "1.2.3.4 " * 50), (None, "call +49 30 1234567 now"), (224, "x@y.zz"), (224, "x@y.zz")]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("private") / "documents.parquet")
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    df.select("*", *[F.lit(0).alias(c) for c in ("row", "spans", "mentions", "word", "n", "entity")]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def by_hand(rows, reach, least, at):
    """Added spans of each row, by plain counting."""
    df, both, contexts, docs, near = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), []
    for r, (_, text) in enumerate(rows):
        spans = plain(text)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for a, b in words:
            df[text[a:b].lower()].add(r)
        for s, k, e in spans:
            value = text[s:e]
            entity = (k, value.lower() if k == 0 else value if k == 1 else re.sub("[^0-9]", "", value))
            docs[entity].add(r)
            at_words = [w for w in words if w[1] <= s][-reach:] + [w for w in words if w[0] >= e][:reach]
            at_words = [w for w in at_words if all(w[1] <= x or w[0] >= y for x, _, y in spans)]
            said = " ".join(text[a:b] for a, b in at_words)
            for a, b in at_words:
                both[entity, text[a:b].lower()].add(r)
                near.append((r, entity, text[a:b].lower(), a, b))
                contexts[entity, text[a:b].lower()].add((r, said))
    out = defaultdict(set)
    for r, entity, word, a, b in near:
        n, n_c, n_t = len(both[entity, word]), len(docs[entity]), len(df[word])
        one = {}
        for row, said in contexts[entity, word]:
            one.setdefault(row, set()).add(said)
        if len(set().union(*one.values())) >= least and n_c < len(rows) and n / n_t >= 0.5 and 1 + math.log2(n / n_t) / math.log2(len(rows) / n_c) >= at:
            out[r].add((a, 4, b))
    return out


def test_terms_by_hand(table):
    found = disclosure.find_personal_data(table).collect()
    rows = table.select("doc_id", "text").collect()
    want = by_hand([tuple(r) for r in rows], 8, 3, 0.85)
    got = sorted(((r["row"], r["doc_id"], [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in found), key=lambda x: x[0])
    assert [g[1] for g in got] == [r["doc_id"] for r in rows]
    for k, ((_, _, spans), r) in enumerate(zip(got, rows, strict=True)):
        assert spans == sorted(plain(r["text"]) + list(want[k]))
        said = {r["text"][a:b] for a, kind, b in spans if kind == 4}
        assert said <= {"Zorblax"} and ("Zorblax" in said) == (r["doc_id"] in range(200, 206))


def test_digests(table):
    for r in disclosure.span_digests(disclosure.find_personal_data(table)).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
        base = plain(r["text"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert set(r["spans"].split(",")) >= {f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in base}


def test_sanitised(table, empty):
    got = {r["doc_id"]: r["text"] for r in disclosure.sanitise(table).collect()}
    assert "jo@ex.org" not in got[203] and "Zorblax" not in got[203] and "[email]" in got[203]
    assert got[220] == "Zorblax without the address" and got[221] is None and got[None] == "call [phone] now"
    assert disclosure.find_personal_data(empty).count() == 0 == disclosure.sanitise(empty).count()


def odd_rows():
    """Entities with words far away in characters, very long words, contexts that recur between documents, and terms elsewhere."""
    rng = random.Random(9)
    some = lambda n: " ".join(f"v{rng.randint(0, 400)}" for _ in range(n))
    out = [(i, some(rng.randint(5, 40))) for i in range(150)]
    for i in range(150, 156):
        out.append((i, f"{some(7)} Farly{' ' * 700}fa@ex.org{' ' * 900}Fardly {some(9)}"))
        out.append((i + 10, f"{some(3)} {'Lo' * 40}ng lo@ex.org {some(12)}"))
        out.append((i + 20, f"{'q' * 300} {'é' * 300} Wide wi@ex.org {some(4)}{i}"))
    same = "se@ex.org Severally " + "aa " * 20
    out += [(190 + i, f"{same}; {some(12)} se@ex.org Severally {some(12)}") for i in range(3)]
    out += [(200, "; ".join(f"mo@ex.org Mostly {some(12)}" for _ in range(4)))]
    return out


def test_words_at_any_distance_and_all_contexts(spark, tmp_path):
    spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in table.collect()]
    want = by_hand(rows, 8, 3, 0.85)
    said = set()
    for r in disclosure.find_personal_data(table).collect():
        text = rows[[d for d, _ in rows].index(r["doc_id"])][1]
        k = [d for d, _ in rows].index(r["doc_id"])
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == sorted(plain(text) + list(want[k]))
        said |= {text[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4}
    assert {"Farly", "Fardly", "Lo" * 40 + "ng", "q" * 300, "é" * 300, "Wide", "Severally", "Mostly"} <= said


def test_terms_wherever_they_stand_beside_an_entity(spark):
    filler = " ".join(f"u{i}" for i in range(40))
    texts = [f"Zorblax {filler} x{i}a x{i}b x{i}c Zorblax jo@ex.org y{i} {filler} zorblax, ZORBLAX" for i in range(4)]
    rows = [*enumerate(texts), (4, "Zorblax elsewhere"), *((i, filler) for i in range(5, 60))]
    found = {r["doc_id"]: r["spans"] for r in disclosure.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        terms = [text[s["start"] : s["end"]] for s in found[i] if s["kind"] == 4]
        assert terms == (["Zorblax", "Zorblax", "ZORBLAX"] if i < 4 else [])  # "zorblax," is another word
    gone = {r["doc_id"]: r["text"] for r in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), remove_at=0.85).collect()}
    assert "Zorblax" not in gone[0] and gone[4] == "Zorblax elsewhere"
