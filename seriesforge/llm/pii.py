"""Personal data: fixed patterns, and terms that give protected entities away.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  For the
terms around them the corpus tells how much they reveal: with N documents, df(t) with a term,
df(c) with an entity and co(c, t) with both in one another's neighbourhood, the term discloses
``PMI(c; t) = log2(N co(c, t) / (df(c) df(t)))`` bits of the entity's ``IC(c) = log2(N / df(c))``.
Every entity is judged.  A term whose share ``PMI / IC`` reaches the threshold, and that enough documents hold,
is generalised (digits to 0, other words to ``[TERM]``) wherever it stands in the documents that
hold the entity; the entity itself is replaced by its kind.

All counts are over all documents.  Only counts, positions and hashes are shuffled.

Defined results: a null text is an empty one and has no spans; equal spans of repeated rows
belong to each row; an entity in every document has no information and no terms.
"""

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import salted_join
from .storage import map_batches, unused, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words before and after an entity in which terms are estimated; what is flagged is masked at any distance.
REACH = 8
#: Documents that must hold a term; entities are all judged, however rare.
SUPPORT = 3
#: Share of the entity's information from which a term counts as disclosing.
DISCLOSURE = 0.8
#: One in so many documents gives a first lower bound of what terms' document counts are.
PART = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the local part is the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 if len(p) < 4 else len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) <= 37 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then start."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
    return found


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _clean(word: str) -> str:
    return word.strip(".,;:!?()[]{}\"'<>|").lower()


def words_before(text: str, end: int) -> list[re.Match]:
    """The last REACH words before a place, whole, however long they are."""
    back = 40 * REACH
    while True:
        # the first word may be cut, so one more than needed
        found = list(_WORD.finditer(text, max(0, end - back), end))
        if back >= end or len(found) > REACH:
            return found[-REACH:]
        back *= 2


def term_span(m: re.Match, term: str) -> tuple[int, int]:
    """Where the cleaned term stands in its word; the whole word where lower case has another length."""
    at = m.start() + m[0].lower().find(term)
    return (at, at + len(term)) if m.string[at : at + len(term)].lower() == term else m.span()


def neighbours(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str, int, int]]:
    """(entity, entity's start, neighbourhood, term, start, end) of the words around each span."""
    taken = sorted((a, b) for _, a, b in spans)
    found = []
    for kind, a, b in spans:
        entity = _key(kind + ":" + re.sub(r"[\x20().-]", "", text[a:b]).lower())
        before = words_before(text, a)
        after = []
        for m in _WORD.finditer(text, b):
            after.append(m)
            if len(after) == REACH:
                break
        words = [m for m in before + after if not any(x < m.end() and m.start() < y for x, y in taken)]
        around = _key(" ".join(m[0] for m in words))
        for m in words:
            if len(term := _clean(m[0])) >= 3:
                found.append((entity, a, around, term, *term_span(m, term)))
    return found


_SCAN = "doc_id {}, text_key long, kind int, entity long, around long, term string, start int, stop int, n long, base string, counts array<long>"


def scan(docs: DataFrame) -> DataFrame:
    """One pass over all texts. kind 0: a document with its base spans; 1: a term beside an entity."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    schema = _SCAN.format(dict(source.dtypes)["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(c) for c in ("doc_id", "text_key", "text"))
            spans = [base_spans(t.as_py()) for t in texts]
            counts = [[sum(s[0] == k for s in found) for k in KINDS] for found in spans]
            n = batch.num_rows
            fill = lambda kind: pa.nulls(n, kind)
            yield _batch(ids, keys, pa.array([0] * n, pa.int32()), fill(pa.int64()), fill(pa.int64()), fill(pa.string()), fill(pa.int32()), fill(pa.int32()), fill(pa.int64()), pa.array([spell(s) for s in spans], pa.string()), pa.array(counts, pa.list_(pa.int64())))
            near = [(k, *x) for k, found in enumerate(spans) if found for x in neighbours(texts[k].as_py(), found)]
            if near:
                n = len(near)
                columns = list(zip(*near))
                rows = pa.array(columns[0])
                yield _batch(ids.take(rows), keys.take(rows), pa.array([1] * n, pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int32()), pa.array(columns[2], pa.int64()), fill(pa.string()), fill(pa.list_(pa.int64())))

    def _batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "text_key", "kind", "entity", "around", "term", "start", "stop", "n", "base", "counts"])

    return map_batches(source, run, schema)


class _Cleaned(dict):
    def __missing__(self, word: str) -> str:
        self[word] = term = _clean(word)
        return term


#: Buckets of the bitmap of wanted terms; its size doesn't grow with the data.
_BITMAP = 1 << 24
#: Terms that a task counts before it hands their counts on.
_COUNTED = 300_000


def _bitmap(wanted: DataFrame):
    marks = np.zeros(_BITMAP, dtype=bool)
    for row in wanted.select((F.crc32("term") % _BITMAP).alias("at")).distinct().toLocalIterator():
        marks[row["at"]] = True
    return wanted.sparkSession.sparkContext.broadcast(np.packbits(marks))


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_key, term, start, stop of the terms of wanted (and of others that share their buckets) in documents with base spans."""
    shared = _bitmap(wanted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            cleaned, marked, found = _Cleaned(), {}, []
            for k, value in enumerate(batch.column("text")):
                text = value.as_py()
                if not (spans := base_spans(text)):
                    continue
                taken = sorted((a, b) for _, a, b in spans)
                ends = np.maximum.accumulate([b for _, b in taken])
                begins = [a for a, _ in taken]
                for m in _WORD.finditer(text):
                    term = cleaned[m[0]]
                    if (hit := marked.get(term)) is None:
                        hit = marked[term] = len(term) >= 3 and bool(marks[zlib.crc32(term.encode("utf-8", "surrogatepass")) % _BITMAP])
                    if hit and not ((before := bisect_left(begins, m.end())) and ends[before - 1] > m.start()):
                        found.append((k, term, *term_span(m, term)))
            if found:
                rows, terms, starts, stops = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), batch.column("text_key").take(pa.array(rows)), pa.array(terms, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["doc_id", "text_key", "term", "start", "stop"])

    return map_batches(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, text_key long, term string, start int, stop int")


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many documents hold each term of wanted (and of others that share its bucket).

    A bitmap of fixed size keeps most other terms out of the shuffle; what is counted doesn't depend on it.
    """
    shared = _bitmap(wanted)
    if not shared.value.any():
        return wanted.select("term", F.lit(0).cast("long").alias("df")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).view(bool)
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "df"])
            counts.clear()
            return out

        for batch in batches:
            cleaned, hit = _Cleaned(), {}
            for text in batch.column("text"):
                for term in {cleaned[w] for w in set(_WORD.findall(text.as_py()))}:
                    if (is_hit := hit.get(term)) is None:
                        is_hit = hit[term] = marks[zlib.crc32(term.encode("utf-8", "surrogatepass")) % _BITMAP]
                    if is_hit:
                        counts[term] += 1
            if len(counts) > _COUNTED:
                yield counted()
        yield counted()

    source = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(source, run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(near: DataFrame, docs: DataFrame, n_docs: int, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, share) of the pairs at or above the threshold.

    A term's documents are at least those where it stands beside an entity, and at least those among
    any part of the documents, which bounds its shares from above.  Both bounds only spare work: every
    term that can still reach the threshold is counted in all documents, and no other could reach it.
    """
    per_entity = near.groupBy("entity").agg(F.countDistinct("doc_id").alias("entity_df"))
    per_term = near.groupBy(F.col("term").alias("of_term")).agg(F.countDistinct("doc_id").alias("near_df"))
    together = near.groupBy("entity", "term").agg(F.countDistinct("doc_id").alias("co")).join(per_entity, "entity")
    n = F.lit(float(max(1, n_docs)))
    informative = F.log2(n / F.col("entity_df"))
    share = lambda df: F.when(informative > 0, F.log2(n * F.col("co") / (F.col("entity_df") * df)) / informative)
    bounded = salted_join(together, F.col("entity"), per_term, F.col("term") == F.col("of_term")).where(share(F.greatest("near_df", F.lit(support))) >= disclosure - 1e-9)
    together = written(bounded.select("entity", "term", "co", "entity_df"), "pii-together")
    some = term_counts(docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(PART)) == 0), together).withColumnRenamed("term", "of_term")
    bounded = salted_join(together, F.col("entity"), some, F.col("term") == F.col("of_term"), "left").where(F.col("df").isNull() | (share(F.col("df")) >= disclosure - 1e-9))
    together = written(bounded.select("entity", "term", "co", "entity_df"), "pii-possible")
    df = term_counts(docs, together).where(F.col("df") >= support).withColumnRenamed("term", "of_term")
    counted = salted_join(together, F.col("entity"), df, F.col("term") == F.col("of_term"))
    return counted.withColumn("share", share(F.col("df"))).where(F.col("share") >= disclosure).select("entity", "term", "share")


def find_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, counts, base, spans (base ones and disclosing terms) of every document."""
    found = written(scan(docs), "pii-scan")
    # documents are counted by rows: repeated rows are documents too
    per_doc = found.where("kind = 0").select("doc_id", "text_key", "counts", "base")
    near = found.where("kind = 1")
    flagged = written(disclosing(near, docs, per_doc.count(), support, disclosure), "pii-flagged")
    beside = near.join(flagged, ["entity", "term"]).select("doc_id", "text_key", "start", "stop")
    protected = near.select("doc_id", "text_key", F.col("entity").alias("of_entity")).distinct()
    held = salted_join(protected, F.col("text_key"), flagged, F.col("of_entity") == F.col("entity")).select("doc_id", "text_key", "term").distinct()
    held = held.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), F.col("term").alias("of_term"))
    stands = occurrences(docs, flagged)
    anywhere = stands.join(held, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")) & (F.col("term") == F.col("of_term")), "left_semi")
    # beside an entity a term can also be part of a word that the entity cuts
    terms = beside.unionByName(anywhere.select("doc_id", "text_key", "start", "stop")).distinct()
    spelled = F.format_string(f"{TERM}:%d:%d", "start", "stop")
    per = terms.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", spelled.alias("s")))).alias("t"))
    per = per.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), F.concat_ws(",", F.transform("t", lambda x: x["s"])).alias("terms"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
    return per_doc.join(per, same, "left").select("doc_id", "text_key", "counts", "base", F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), "terms").alias("spans"))


def mask(text: str, spans: str) -> str:
    """The text with each span replaced; where spans overlap, what they cover together is replaced once."""
    found = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)))
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], _generalised(text[a:-b], kind)]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def _generalised(piece: str, kind: str) -> str:
    if kind == TERM and _DIGIT.search(piece):
        return _DIGIT.sub("0", piece)
    return f"[{kind.upper()}]"


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with their texts' spans masked; columns as before (n_chars, if there, follows the new text)."""
    of, of_key, marks = unused(docs, "of", "of_key", "marks")
    marked = spans.where(F.col("spans") != "").groupBy(F.col("doc_id").alias(of), F.col("text_key").alias(of_key)).agg(F.first("spans").alias(marks))

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else mask(t, s) for t, s in zip(texts, spans)], dtype=object)

    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(of_key))
    joined = docs.join(marked.hint("shuffle_hash"), same, "left")
    out = joined.withColumn("text", F.when(F.col(marks).isNull(), F.col("text")).otherwise(masked("text", marks)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(marks).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
