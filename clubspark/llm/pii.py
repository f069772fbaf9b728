"""Personal data, and the words around it that give it away, by what the corpus says of both.

A protected entity is a found value: an address, a number.  A word next to it reveals it when seeing
the word makes the entity likely: with p taken over documents, the pointwise mutual information
ln(p(c, t) / (p(c) p(t))) is the part of the entity's information -ln p(c) that the word discloses.
Words that disclose more than a share of it are replaced by their class (a number, a code, a name, a
word) if that class discloses less, and are removed otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import prepare, sha, small
from clubspark.session import materialize

#: The kinds in their order, and the characters of an address before its sign.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the method adds, after the kinds above.
ADDED = ("generalise", "remove")

#: Words looked at on either side of an entity.
WINDOW = 8
#: Share of an entity's information from which on a word discloses it.
DISCLOSURE = 0.8
#: Different surroundings in which a word must stand by an entity; a copied text counts once.
SUPPORT = 3

WORD = re.compile(r"[^\W_]+")
#: Longer words are known by their hash.
LONG_WORD = 64
#: Different words a task counts before it passes their counts on.
COUNTED = 200_000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in map(int, digits[-2::-2]):
        total += d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, each sign looked at once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _digits(match: str) -> str:
    return re.sub("[^0-9]", "", match)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the personal data, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def entity(kind: int, match: str) -> str:
    """What is protected: the value without its spelling, hashed if it is long."""
    value = match.lower() if kind == 0 else match if kind == 1 else _digits(match)
    return f"{KINDS[kind]}:{value if len(value) <= 2 * LONG_WORD else hashlib.sha256(value.encode()).hexdigest()}"


def word_class(word: str) -> str:
    """What a word is generalised to; no word holds a bracket."""
    if word.isdigit():
        return "<number>"
    if any(ch.isdigit() for ch in word):
        return "<code>"
    return "<name>" if word[0].isupper() else "<word>"


def term(word: str) -> str:
    lower = word.lower()
    return lower if len(lower) <= LONG_WORD else hashlib.sha256(lower.encode()).hexdigest()


def surroundings(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Per entity found: its name, a hash of the words around it, and their places; words inside a span are none."""
    if not spans:
        return
    covered, last = [], -1
    for start, _, end in spans:
        if covered and start < last:
            last = covered[-1][1] = max(last, end)
        else:
            covered.append([start, end])
            last = end
    starts = [s for s, _ in covered]
    words = []
    for m in WORD.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        inside = k >= 0 and covered[k][1] > m.start()
        if not inside and not (k + 1 < len(starts) and starts[k + 1] < m.end()):
            words.append(m.span())
    begins = [b for b, _ in words]
    for start, kind, end in spans:
        i, j = bisect_left(begins, start), bisect_left(begins, end)
        near = words[max(0, i - WINDOW) : i] + words[j : j + WINDOW]
        around = "\0".join(text[b:e].lower() for b, e in near)
        yield entity(kind, text[start:end]), int.from_bytes(hashlib.blake2b(around.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True), near


_NEAR = "entity string, term string, class string, context long, start long, end long"
_FOUND = f"kinds array<string>, starts array<long>, ends array<long>, near array<struct<{_NEAR.replace(' ', ':').replace(',:', ',')}>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ") for part in _NEAR.split(", ")]
    near_type = pa.list_(pa.struct([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in names]))
    for batch in batches:
        spans, near = [], []
        for body in batch.column("text").to_pylist():
            text = body.decode("utf-8", "replace")
            found = base_spans(text)
            spans.append(found)
            rows = []
            for name, context, places in surroundings(text, found):
                rows.append((name, None, None, context, None, None))
                rows += [(name, term(text[b:e]), word_class(text[b:e]), context, b, e) for b, e in places]
            near.append([dict(zip([n for n, _ in names], row, strict=True)) for row in rows])
        columns = [
            pa.array([[KINDS[k] for _, k, _ in f] for f in spans], pa.list_(pa.string())),
            pa.array([[s for s, _, _ in f] for f in spans], pa.list_(pa.int64())),
            pa.array([[e for _, _, e in f] for f in spans], pa.list_(pa.int64())),
            pa.array(near, near_type),
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sha"), *columns], ["doc_id", "sha", "kinds", "starts", "ends", "near"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it), each task's counts passed on whenever they are many."""
    counts: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    for batch in batches:
        for body in batch.column("text").to_pylist():
            words = set(WORD.findall(body.decode("utf-8", "replace")))
            terms = {term(w) for w in words}
            terms.update({word_class(w) for w in words})
            for t in terms:
                counts[t] = counts.get(t, 0) + 1
        if len(counts) > COUNTED:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def _bodies(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", body.alias("text"), sha(docs["text"]).alias("sha"))


def supported(near: DataFrame, support: int) -> DataFrame:
    """(entity, term, together): words and classes by an entity in enough different surroundings, and in how many rows."""
    pairs = near.select("doc", "entity", "context", F.explode(F.array_distinct(F.array("term", "class"))).alias("term"))
    contexts = pairs.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    rows = pairs.select("entity", "term", "doc").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    enough = contexts.where((F.col("contexts") >= support) | F.col("term").isNull()).withColumnsRenamed({"entity": "e", "term": "t"})
    same = (rows["entity"] == enough["e"]) & rows["term"].eqNullSafe(enough["t"])
    return rows.join(enough, same).select("entity", "term", "together")


def disclosing(seen: DataFrame, terms: DataFrame, documents: int, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, share): the pairs of ``supported`` in which the term discloses at least that share of the entity.

    terms: (term, n), the rows that hold each term of the pairs.
    """
    holding = seen.where(F.col("term").isNull()).select(F.col("entity").alias("e"), F.col("together").alias("holding"))
    known = F.log(F.lit(float(documents)) / F.col("holding"))
    gain = F.log(F.col("together") * F.lit(float(documents)) / (F.col("holding") * F.col("n")))
    pairs = seen.where(F.col("term").isNotNull()).join(small(terms), "term").join(holding, F.col("entity") == F.col("e"))
    return pairs.where((known > 0) & (gain >= known * F.lit(disclosure))).select("entity", "term", (gain / known).alias("share"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, sha (of the text), and all spans of each row by start, then kind: kinds, starts, ends (code points).

    Kinds are those of KINDS, always found, and of ADDED: words within WINDOW words of an entity that
    disclose at least ``disclosure`` of its information, seen by it in ``support`` different surroundings.
    A word that discloses several entities is removed if one of them asks for it.
    Null and empty texts have no spans.  Texts of any length are read whole, in time linear in it.
    Rows that agree in doc_id and text get the same spans each; an empty table gives an empty result;
    further columns are not looked at.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bodies = _bodies(docs)
    found = materialize(bodies.mapInArrow(_find, f"doc_id {kind}, sha binary, {_FOUND}"))
    documents = found.count()
    near = found.where(F.size("near") > 0).withColumn("doc", F.monotonically_increasing_id())
    near = materialize(near.select("doc", "doc_id", "sha", F.inline("near")))
    seen = materialize(supported(near, support))
    counted = bodies.select("doc_id", "text").mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    wanted = small(materialize(seen.where(F.col("term").isNotNull()).select("term").distinct()))
    terms = materialize(counted.join(wanted, "term", "left_semi"))
    told = small(materialize(disclosing(seen, terms, documents, disclosure)))
    hits = near.join(told.select("entity", "term"), ["entity", "term"], "left_semi")
    class_told = told.select(F.col("entity").alias("e"), F.col("term").alias("c"), F.lit(True).alias("told"))
    classed = hits.join(class_told, (F.col("entity") == F.col("e")) & (F.col("class") == F.col("c")), "left")
    added = classed.groupBy("doc_id", "sha", "start", "end").agg(F.max(F.coalesce("told", F.lit(False))).alias("told"))
    kind_no = F.when(F.col("told"), len(KINDS) + 1).otherwise(len(KINDS)).alias("kind")
    spans = added.groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", kind_no, "end")).alias("added"))
    spans = spans.select(F.col("doc_id").alias("i"), F.col("sha").alias("t"), "added")
    joined = found.join(small(materialize(spans)), (found["sha"] == F.col("t")) & found["doc_id"].eqNullSafe(F.col("i")), "left")
    order = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    base = F.transform(
        F.arrays_zip("starts", "kinds", "ends"),
        lambda x: F.struct(x["starts"].alias("start"), (F.array_position(order, x["kinds"]) - 1).cast("int").alias("kind"), x["ends"].alias("end")),
    )
    every = F.array_sort(F.concat(base, F.coalesce(F.col("added"), F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    return joined.withColumn("every", every).select(
        "doc_id",
        "sha",
        F.transform("every", lambda x: F.element_at(order, x["kind"] + 1)).alias("kinds"),
        F.transform("every", lambda x: x["start"]).alias("starts"),
        F.transform("every", lambda x: x["end"]).alias("ends"),
    )


def sanitise_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Entities become their kind, generalised words their class, removed words nothing; overlapping spans are one."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= done:
            out.append(text[done:start])
            out.append({"generalise": word_class(text[start:end]), "remove": ""}.get(kind, f"<{kind}>"))
        done = max(done, end)
    return "".join([*out, text[done:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, last = batch.schema.get_field_index("text"), batch.num_columns - 1
        spans = [[(x["starts"], x["ends"], x["kinds"]) for x in row or ()] for row in batch.column(last).to_pylist()]
        texts = [sanitise_text(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), spans, strict=True)]
        clean = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
        yield pa.RecordBatch.from_arrays(clean.columns[:last], clean.schema.names[:last])


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The documents, their columns kept, with every span of ``find`` generalised or removed; a null text stays null."""
    spans = materialize(find(docs, disclosure, support).where(F.size("kinds") > 0).dropDuplicates(["doc_id", "sha"]))
    zipped = F.arrays_zip("starts", "ends", "kinds").alias("spans")
    spans = small(spans.select(F.col("doc_id").alias("i"), F.col("sha").alias("t"), zipped))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), sha(docs["text"]).alias("sha"))
    joined = rows.join(spans, (rows["sha"] == F.col("t")) & rows["row.doc_id"].eqNullSafe(F.col("i")), "left")
    return joined.select("row.*", "spans").mapInArrow(_sanitise, docs.schema)


def span_text(kinds: Column, starts: Column, ends: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(
        F.arrays_zip(kinds.alias("k"), starts.alias("s"), ends.alias("e")), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])
    )
