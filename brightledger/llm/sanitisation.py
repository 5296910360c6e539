"""Personal data, and the terms that disclose it, found and sanitised.

Identifiers (e-mail and IP addresses, card and phone numbers) are found by their form;
they are the protected entities. A term beside an identifier discloses it as far as
knowing the term tells it: by pointwise mutual information over the documents of the
corpus, in parts of the identifier's own information content. Terms above a threshold
are generalised, those above a higher one are removed, wherever they stand in a document
that names the identifier.

With N documents, ``dc`` of them with entity c, ``dt`` with term t and ``co`` with t in a
window around c: PMI(c, t) = ln(N co / (dc dt)), IC(c) = ln(N / dc), and the disclosure
of c by t is PMI / IC, which is 1 when every document with t has c beside it. A pair
counts with SUPPORT different windows at least, so that copies of one text prove nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, saved, small_batches, spread_join, table

#: Kinds of identifiers, in the order in which spans that begin together are listed; terms come last.
KINDS = ["email", "ip", "card", "phone"]
#: Words on either side of an identifier that can disclose it, and different windows that a pair needs.
WINDOW, SUPPORT = 5, 3
#: Disclosures from which a term is generalised, and from which it is removed.
GENERALISED, REMOVED = 0.8, 0.95

# The forms of identifiers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A word: what holds no ASCII character but letters and digits, and no general or CJK punctuation. The same in Python and Java.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u2000-\u206F\u3000-\u303F]+"
WORDS = re.compile(WORD)

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from each @ so that long words cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def passes_luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def identifiers(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind, end and normalised value of every identifier, by start, then kind."""
    found = [(i, 0, j, text[i:j].lower()) for i, j in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.groups()]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end(), ".".join(parts)))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = digits_of(m[0])
            if 9 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def told(spans: list[Span]) -> str:
    """Spans of (start, kind, end) as text."""
    names = [*KINDS, "term"]
    return ",".join(f"{names[k]}:{i}:{j}" for i, k, j in spans)


def free_words(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where the words stand that touch none of the spans ``taken``, which are in order of their starts."""
    out, n, reach = [], 0, 0
    for m in WORDS.finditer(text):
        while n < len(taken) and taken[n][0] < m.end():
            reach = max(reach, taken[n][1])
            n += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def windows(text: str, found: list[tuple[int, int, int, str]]) -> list[dict]:
    """For each identifier its entity and the words of its window."""
    places = free_words(text, [(i, j) for i, _, j, _ in found])
    starts = [i for i, _ in places]
    out = []
    for i, k, j, value in found:
        left, right = bisect_left(starts, i), bisect_left(starts, j)
        near = places[max(0, left - WINDOW) : left] + places[right : right + WINDOW]
        out.append({"entity": f"{KINDS[k]}:{value}", "words": [text[a:b] for a, b in near]})
    return out


FOUND = "doc_id long, row string, counts array<long>, base string, mentions array<struct<entity:string,words:array<string>>>, text string"
MENTIONS = pa.list_(pa.struct([("entity", pa.string()), ("words", pa.list_(pa.string()))]))


def row_name(doc_id: Column, text: Column) -> Column:
    """The name of a row: rows of one id and one text share it, as they share all results."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, row, counts by kind, base spans and mentions of every row, saved; the text only where it has identifiers."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, mentions, kept = [], [], [], []
            for t in batch.column("text").to_pylist():
                found = identifiers(t)
                counts.append([sum(k == n for _, k, _, _ in found) for n in range(len(KINDS))])
                base.append(told([s[:3] for s in found]))
                mentions.append(windows(t, found) if found else [])
                kept.append(t if found else None)
            whole = [batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string())]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(mentions, MENTIONS), pa.array(kept, pa.string())], names=["doc_id", "row", "counts", "base", "mentions", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_name(F.col("doc_id"), text).alias("row"), text.alias("text"))
    return saved(rows.mapInArrow(each, FOUND))


def words_of(text: str) -> Column:
    """A row for each different word of the column."""
    return F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).alias("term")


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, support, co, entity_docs, term_docs and disclosure of the pairs of terms that disclose an entity, saved.

    ``found`` is of ``found_in``; counts of terms are over all rows of ``docs``.
    """
    mentions = found.where("text IS NOT NULL").select("row", F.explode("mentions").alias("m"))
    beside = mentions.select("row", "m.entity", F.md5(F.array_join("m.words", " ")).alias("window"), F.explode(F.array_distinct("m.words")).alias("term"))
    beside = saved(beside.where("term <> ''"))
    count = lambda rows, *keys: rows.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    support = count(beside.select("entity", "term", "window"), "entity", "term").withColumnRenamed("n", "support").where(F.col("support") >= SUPPORT)
    co = count(beside.select("entity", "term", "row"), "entity", "term").withColumnRenamed("n", "co")
    entities = count(mentions.select("m.entity", "row"), "entity").withColumnRenamed("n", "entity_docs")
    pairs = support.join(co, ["entity", "term"]).join(entities, "entity")
    # All words are counted, and looked up as counts: occurrences of the pairs' words are as many as all words, in the end.
    terms = docs.select(words_of("text")).groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    n = F.lit(found.count()).cast("double")
    content = F.log(n / F.col("entity_docs"))
    disclosure = F.when(content > 0, F.log(n * F.col("co") / F.col("entity_docs") / F.col("term_docs")) / content)
    return saved(terms.join(pairs, "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= GENERALISED))


def term_spans(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, spans (base ones and those of terms) and actions (of the terms, in order) of the rows with a term that discloses one of their entities."""
    entities = found.where("text IS NOT NULL").select("row", F.explode("mentions.entity").alias("entity")).distinct()
    concerned = entities.join(pairs.select("entity").distinct(), "entity", "left_semi").select("row").distinct()
    texts = saved(found.where("text IS NOT NULL").join(concerned, "row", "left_semi").dropDuplicates(["row"]).select("row", "text"))
    words = saved(texts.select("row", words_of("text")).join(pairs.select("term").distinct(), "term", "left_semi"))
    sizes = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = spread_join(words, pairs.select("term", "entity", "disclosure"), "term", hot_keys(sizes, "term"), "row").join(entities, ["row", "entity"], "left_semi")
    most = each.groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    terms = most.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))  # different words of one text at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, actions = [], []
            for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                level, base = dict(terms), [s[:3] for s in identifiers(text)]
                own = [(i, len(KINDS), j) for i, j in free_words(text, [(i, j) for i, _, j in base]) if text[i:j] in level]
                spans.append(told(sorted(base + own)))
                actions.append(["removed" if level[text[i:j]] >= REMOVED else "generalised" for i, _, j in own])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, pa.string()), pa.array(actions, pa.list_(pa.string()))], names=["row", "spans", "actions"])

    return texts.join(terms, "row").mapInArrow(place, "row string, spans string, actions array<string>")


def sensitive_spans(docs: DataFrame) -> DataFrame:
    """Identifiers and disclosing terms of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. Null text counts as empty.
    Returns a row for each row: doc_id, counts (by KINDS), base (spans of identifiers as
    kind:start:end, in code points, end exclusive, by start, then kind), spans (the same
    with terms, which never touch an identifier), actions (of the terms in order) and
    row (its name). Rows with neither give empty texts. Identifiers of different kinds
    may overlap; of one kind, the leftmost longest ones count, and one that fails its
    test is dropped without another try. Repeated rows are returned each and count as
    one document; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    found = found_in(docs)
    more = saved(term_spans(found, disclosures(docs, found)))
    whole = found.select("doc_id", "row", "counts", "base").join(more, "row", "left")
    return whole.select("doc_id", "row", "counts", "base", F.coalesce("spans", "base").alias("spans"), F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))


def replacement(kind: str, text: str, action: str) -> str:
    """What stands for a span: identifiers keep what many share (a domain's last label, the first two parts of an address)."""
    if kind == "email":
        return f"[email .{text.rsplit('.', 1)[1]}]"
    if kind == "ip":
        return "{}.{}.*.*".format(*text.split(".")[:2])
    if kind != "term":
        return f"[{kind}]"
    return "" if action == "removed" else "[number]" if text[0].isdigit() else "[name]" if text[0].isupper() else "[word]"


def rewritten(text: str, spans: str, actions: list[str]) -> str:
    """``text`` with its spans replaced, of overlapping ones the first."""
    out, done, acts = [], 0, iter(actions)
    for kind, start, end in (s.split(":") for s in spans.split(",")):
        action = next(acts) if kind == "term" else ""
        i, j = int(start), int(end)
        if i >= done:
            out += [text[done:i], replacement(kind, text[i:j], action)]
        done = max(done, j)
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``docs``, with identifiers and disclosing terms generalised or removed."""
    changed = sensitive_spans(docs).where("spans <> ''").select("row", "spans", "actions").dropDuplicates(["row"])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_name(F.col("doc_id"), text).alias("row"), text.alias("text")).join(changed, "row", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if s is None else rewritten(t, s, a) for t, s, a in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "actions")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(each, "doc_id long, text string")


def op13_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sensitive_spans(table(spark, sf_dir, "documents"))
    counts = [F.get("counts", F.lit(i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
