"""Personal data in texts, and the terms around it that give it away: information-theoretic sanitisation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .textblocks import blocks, word_hashes

#: Kinds of entities in the order of the output; terms that disclose one come last.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = str.maketrans("", "", " -().+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Distinct words that a task gathers before it passes their counts on.
MOST_WORDS = 1_000_000


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The part before an @ is the whole run of its characters, as far as no earlier match reaches: found backwards from the @.
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            last = domain.end()
            yield lo, last
        else:
            last = at + 1  # nothing before this @ can begin a match after it
        at = text.find("@", last)


def personal_data(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of emails, ip addresses, card and phone numbers, in order; each kind's own leftmost
    matches that don't overlap, less those that fail the kind's check."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := m[0].translate(_NO_DIGIT)) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(_NO_DIGIT)) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _key(value: bytes) -> int:
    """An entity or context by 64 bits of its digest, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "big", signed=True)


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else value.translate(_NO_DIGIT)}"


def free_words(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, and whether it overlaps no base span."""
    at = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    begins, ends = at[:, 0], at[:, 1]
    cover: list[list[int]] = []  # where any span lies, as spans of several kinds may overlap
    for a, _, b in spans:
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    stops = np.array([0] + [c[1] for c in cover])
    return begins, ends, stops[np.searchsorted([c[0] for c in cover], ends)] <= begins


def surroundings(begins: np.ndarray, ends: np.ndarray, free: np.ndarray, spans: list[tuple[int, int, int]], reach: int) -> Iterator[np.ndarray]:
    """For each base span, which words are at most `reach` words from it and overlap no base span."""
    lefts, rights = np.searchsorted(ends, [a for a, _, _ in spans], side="right"), np.searchsorted(begins, [b for _, _, b in spans])
    for left, right in zip(lefts.tolist(), rights.tolist(), strict=True):
        near = np.r_[max(0, left - reach) : left, right : min(right + reach, len(free))]
        yield near[free[near]]


def _hashes(texts: list[str], lower: bool) -> Iterator[np.ndarray]:
    """Each text's words by textblocks' hash."""
    for _, _, raw, offsets in blocks(pa.array(texts, pa.large_string())):
        words, bounds = word_hashes(raw, offsets, lower=lower)
        yield from (words[a:b].view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def words_by_document(docs: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word stands, A-Z in lower case, counted inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        held, counts, size = [none[0]], none, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            words, place = np.unique(np.concatenate((counts[0], keys)), return_inverse=True)
            return words, np.bincount(place, weights=np.concatenate((counts[1], n)), minlength=len(words)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts[0].view(np.int64)), pa.array(counts[1])], names=["word", "n"])

        for batch in batches:
            for _, _, raw, offsets in blocks(batch.column(0)):
                words, bounds = word_hashes(raw, offsets, lower=True)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.lexsort((words, owner))
                w, o = words[order], owner[order]
                new = np.ones(len(w), dtype=bool)
                new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
                held.append(w[new])
                size += len(held[-1])
                if size > MOST_WORDS:
                    counts, held, size = merged(), [none[0]], 0
                    if len(counts[0]) > MOST_WORDS:
                        yield rows()
                        counts = none
        counts = merged()
        if len(counts[0]):
            yield rows()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


SPANS = "array<struct<start:int,kind:int,end:int>>"
MENTIONS = "array<struct<entity:long,context:long,words:array<long>>>"


def base_spans(numbered: DataFrame, reach: int) -> DataFrame:
    """(row, doc_id, spans, mentions, text) of each text, from row, doc_id, text: its base spans, and for each the entity and the
    words around it; the text is null where there are none. Entities and whole contexts are known by 64 bits of a digest, words by
    textblocks' hash."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mention = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("words", pa.list_(pa.int64()))]))
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("spans", span), ("mentions", mention), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            spans = [personal_data(text or "") for text in texts]
            held = [text if found else None for text, found in zip(texts, spans, strict=True)]
            some = [text for text in held if text is not None]
            said, exact = _hashes(some, lower=True), _hashes(some, lower=False)
            mentions: list[list[dict]] = []
            for text, found in zip(held, spans, strict=True):
                mentions.append([])
                if text is not None:
                    words, cased = next(said), next(exact)
                    for (a, kind, b), near in zip(found, surroundings(*free_words(text, found), found, reach), strict=True):
                        mentions[-1].append({"entity": _key(_entity(kind, text[a:b]).encode()), "context": _key(cased[near].tobytes()), "words": words[near].tolist()})
            told = [[{"start": a, "kind": k, "end": b} for a, k, b in found] for found in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(told, span), pa.array(mentions, mention), pa.array(held, pa.string())], schema=fields)

    return numbered.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id long, spans {SPANS}, mentions {MENTIONS}, text string")


def disclosing_terms(found: DataFrame, words: DataFrame, n_docs: int, least_contexts: int, generalise_at: float) -> DataFrame:
    """(entity, word, disclosure): the words that reveal an entity.

    How much of an entity's information a word near it gives away is their pointwise mutual information over the
    entity's own: PMI(c; t) / IC(c), of shares of documents. A word discloses an entity if that reaches generalise_at,
    if the entity stands near most of the documents' uses of it, and if they meet in least_contexts different contexts, in
    whichever documents (copies of a passage are one context). An entity that every document holds has no information to give.
    """
    near = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    entities = near.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    met = near.select("row", "entity", "context", F.explode("words").alias("word")).groupBy("entity", "word")
    met = met.agg(F.count_distinct("row").alias("n_both"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= least_contexts)
    told = met.join(entities, "entity").join(words, "word").where(F.col("n_entity") < n_docs)
    share = F.col("n_both") / F.col("n")
    own = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    told = told.withColumn("disclosure", 1 + F.log2(share) / own).where((F.col("disclosure") >= generalise_at) & (share >= 0.5))
    return told.select("entity", "word", "disclosure")


def marked_terms(wanted: DataFrame) -> DataFrame:
    """(row, terms): where the wanted words (word, disclosure) of a text stand, from row, text, spans, wanted."""
    term = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())]))
    fields = pa.schema([("row", pa.int64()), ("terms", term)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, terms = batch.column(1).to_pylist(), []
            for text, words, found, told in zip(texts, _hashes(texts, lower=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                begins, ends, free = free_words(text, [(s["start"], s["kind"], s["end"]) for s in found])
                tells = {t["word"]: t["disclosure"] for t in told}
                at = np.flatnonzero(free & np.isin(words, list(tells)))
                terms.append([{"start": a, "kind": KINDS.index("term"), "end": b, "disclosure": tells[w]} for a, b, w in zip(begins[at].tolist(), ends[at].tolist(), words[at].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, term)], schema=fields)

    return wanted.select("row", "text", "spans", "wanted").mapInArrow(run, "row long, terms array<struct<start:int,kind:int,end:int,disclosure:double>>")


def find_personal_data(docs: DataFrame, reach: int = 8, least_contexts: int = 3, generalise_at: float = 0.85) -> DataFrame:
    """Personal data of each text, and the words in it that disclose it.

    docs: doc_id, text (more columns are ignored). Returns row (the place in the input), doc_id, spans (start, kind, end,
    disclosure, by start, then kind; kinds as in KINDS; base kinds have no disclosure) - one row per row of docs,
    repeated rows too. Null and empty texts have no spans; an empty table gives an empty table; null doc_ids stay.
    Base spans are found by pattern, each kind for itself, in the whole text. Terms are learnt by disclosing_terms() from words of
    any length at most `reach` words from a mention, and marked wherever they stand in a text that holds what they disclose (the
    most that any of its entities loses by them is their disclosure). Terms never overlap base spans.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(base_spans(numbered, reach), "private-spans")
    near = found.where(F.size("mentions") > 0)
    told = stage(disclosing_terms(near, words_by_document(docs), found.count(), least_contexts, generalise_at), "private-terms")
    held = near.select("row", F.explode(F.array_distinct("mentions.entity")).alias("entity"))
    wanted = held.join(told, "entity").groupBy("row", "word").agg(F.max("disclosure").alias("disclosure"))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("word", "disclosure")).alias("wanted"))  # of one text
    terms = marked_terms(near.join(wanted, "row"))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("disclosure")))
    both = found.join(terms, "row", "left").withColumn("all", F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, F.col("terms"))))
    return both.select("row", "doc_id", F.array_sort("all").alias("spans"))


def sanitise(docs: DataFrame, remove_at: float = 0.95, **options) -> DataFrame:
    """(doc_id, text): texts with their personal data taken out. Base spans become their kind in brackets; terms are
    removed from a disclosure of remove_at on, and else generalised to what sort of word they are. Null texts stay null."""
    spans = find_personal_data(docs, **options)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    fields = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def general(word: str) -> str:
        return "[number]" if any(c.isdigit() for c in word) else "[name]" if word[:1].isupper() else "[word]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for s in found if text else ():
                    parts.append(text[at : s["start"]])
                    if s["start"] >= at:  # else a span of another kind has covered its beginning
                        parts.append(f"[{KINDS[s['kind']]}]" if s["disclosure"] is None else "" if s["disclosure"] >= remove_at else general(text[s["start"] : s["end"]]))
                    at = max(at, s["end"])
                out.append(text if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=fields)

    return spans.join(texts, "row").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    name = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["disclosure"].isNull())
    return found.select("doc_id", *map(of, range(len(KINDS))), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
