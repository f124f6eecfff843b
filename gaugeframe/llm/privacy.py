"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base entities (email, ip, card, phone) are found by pattern.  The method then asks which other words of a document give such an entity away:
over all documents it counts in how many an entity and a term stand together, at any distance, and how many hold the term at all.  With
IC(e) = -log2 p(e), a term discloses log2(p(t, e) / (p(t) p(e))) bits of entity e; at ``DISCLOSURE`` times IC(e) or more the term is
sanitised wherever the entity's document uses it.  Terms also have a class, their first four letters; if the class discloses less than the
threshold the term is generalised to it, else it is removed.  ``SUPPORT`` distinct contexts are needed, so that copies of one passage, which
are one observation, prove nothing: a document counts with one of its contexts (the text beside a mention), or a term stands in that many
contexts itself.  The text beside a mention is ``CONTEXT`` characters to either side, and ends at the next run that has the pattern's shape.

Terms travel as 64-bit hashes; words are read again only in documents where one of them was flagged.  Entities that share their documents are one
group, so a document with many entities and many terms does not multiply them.

Positions come from the lengths of matches and of the text between them, summed by a window inside one document; texts of documents without
personal data are scanned once and never shuffled.  Patterns are the contract's with possessive loops and look-behinds that change no match but
keep every scan linear.

Defined results.  A null text is empty.  Rows with equal id and text get equal results; they are one document among an entity's documents, and
rows of their own in the counts of terms and of the corpus; a null ``doc_id`` is an
id like any other.  An empty table gives an empty result.  All columns are kept by :func:`sanitise`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.llm.common import fresh, row_key, stored

# Entity kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all; spares most texts the scan.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"  # of a run of digits
WORDS = r"\p{L}++"
CONTEXT, PREFIX = 120, 4
SUPPORT, DISCLOSURE = 3, 0.9
SPANS = "array<struct<start:bigint,rank:bigint,end:bigint,kind:string,value:string>>"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(digits, n + 1 - i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    luhn = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
    return (
        (kind == "email")
        | ((kind == "ip") & value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        | ((kind == "card") & F.when(n.between(12, 19), luhn).otherwise(False))
        | ((kind == "phone") & n.between(9, 15))
    )


def _found(text: Column, kind: str) -> Column:
    pattern = F.lit(PATTERNS[kind])
    possible = F.length(text) > 0 if not NEEDS[kind] else F.contains(text, F.lit(NEEDS[kind]))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(possible, F.struct(F.lit(kind).alias("kind"), matches.alias("values"), F.split(text, PATTERNS[kind], -1).alias("gaps")))


def _placed(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per match of (keys, values, gaps): value, start and end in code points, and the text near it."""
    each = found.select(*keys, F.posexplode(F.transform("values", lambda v, i: F.struct(
        v.alias("value"), F.length(F.col("gaps")[i]).alias("gap"), F.substring(F.col("gaps")[i], -CONTEXT, CONTEXT).alias("before"),
        F.substring(F.col("gaps")[i + 1], 1, CONTEXT).alias("after")))).alias("at", "m")).select(*keys, "at", "m.*")
    upto = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.length("value")).cast("long")).over(upto)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def mentions(docs: DataFrame) -> DataFrame:
    """Base entities of every distinct (id, text): _id, _tk, kind, rank, value, start, end, before, after."""
    text = F.col("text")
    scanned = docs.select(*row_key(), F.array(*[_found(text, k) for k in KINDS]).alias("kinds"))
    each = scanned.select("_id", "_tk", F.explode(F.filter("kinds", lambda x: F.size(x["values"]) > 0)).alias("x")).select("_id", "_tk", "x.*")
    # equal rows are one document
    each = each.dropDuplicates(["_id", "_tk", "kind"])
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("long")
    placed = _placed(each, ["_id", "_tk", "kind"]).where(_valid(F.col("kind"), F.col("value")))
    return placed.select("_id", "_tk", "kind", rank.alias("rank"), "value", "start", "end", "before", "after")


def _terms(text: Column) -> Column:
    """Distinct lower-case words and their classes by hash: (term, class of a word or null)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))
    classes = F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, PREFIX)))
    named = F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("term"), _class(F.substring(w, 1, PREFIX)).alias("class")))
    return F.concat(named, F.transform(classes, lambda c: F.struct(_class(c).alias("term"), F.lit(None).cast("long").alias("class"))))


def _class(prefix: Column) -> Column:
    return F.xxhash64(F.concat(prefix, F.lit("*")))


def _owners(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the entities, and the group of every entity.

    Entities with the same documents and the same pattern of equal contexts among them give the same counts for every term, so they are one group
    (g1, g2: order-free hashes of documents and contexts).  Returns (_id, _tk, g1, g2, context, e_docs) and (kind, value, g1, g2).
    """
    each = told.groupBy("_id", "_tk", "kind", "value").agg(F.min("context").alias("context"), F.max("e_docs").alias("e_docs"))
    doc = F.xxhash64("_id", "_tk")
    # a context is named by its first document, alike for all entities
    named = each.groupBy("kind", "value", "context").agg(F.min(doc).alias("first"))
    each = stored(each.join(named, ["kind", "value", "context"]).drop("context"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "_id", "_tk", "first")).alias(f"g{k}") for k in (1, 2)]
    groups = stored(each.groupBy("kind", "value").agg(*marks))
    owners = each.join(groups, ["kind", "value"]).groupBy("_id", "_tk", "g1", "g2").agg(F.min("first").alias("context"), F.max("e_docs").alias("e_docs"))
    return stored(owners), groups


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(_id, _tk, term, action): hashes of the terms that give an entity of the document away; action is ``generalise`` or ``remove``.

    A term's joint count is at most e_docs, so it can only disclose the share ``disclosure`` of an entity when it stands in no more than
    ``e_docs * (n / e_docs) ** (1 - disclosure)`` documents.  Commoner terms leave before they meet an entity; none of them could be flagged.
    """
    doc, group, entity = ["_id", "_tk"], ["g1", "g2"], ["kind", "value"]
    near = found.select(*doc, *entity, F.concat_ws(" ", "before", "after").alias("near"), F.xxhash64("before", "after").alias("context"))
    entities = near.groupBy(*entity).agg(
        F.countDistinct("context").alias("contexts"), F.countDistinct(*doc).alias("e_docs")).where(F.col("contexts") >= support).drop("contexts")
    told = stored(near.join(entities, entity))
    owners, groups = _owners(told.drop("near"))
    close = told.select(*entity, "context", F.explode(_terms(F.col("near"))["term"]).alias("term")).groupBy(*entity, "term").agg(
        F.countDistinct("context").alias("close")).where(F.col("close") >= support).drop("close")
    close = stored(close.join(groups, entity))
    n, widest = docs.count(), told.agg(F.max("e_docs")).first()[0]
    if not widest:
        return owners.select(*doc, F.col("g1").alias("term"), F.lit("").alias("action"))  # no entities: an empty table

    def reach(e_docs: Column) -> Column:
        return e_docs * F.pow(F.lit(float(n)) / e_docs, F.lit(1 - disclosure)) * F.lit(1 + 1e-9)

    # counted in the map tasks first; then one row per term that is rare enough for the widest entity
    spread = docs.select(F.explode(_terms(F.col("text"))["term"]).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("t_docs"))
    spread = stored(spread.where(F.col("t_docs") <= reach(F.lit(float(widest)))))
    texts = docs.select("text", *row_key()).join(owners.groupBy(*doc).agg(F.max("e_docs").alias("widest")), doc).dropDuplicates(doc)
    held = texts.select(*doc, "widest", F.explode(_terms(F.col("text"))).alias("x")).select(*doc, "widest", "x.*")
    held = stored(held.join(spread, "term").where(F.col("t_docs") <= reach(F.col("widest"))).drop("widest"))
    # a term of fewer documents than contexts are needed counts only where it stands close to the entity
    often = held.where(F.col("t_docs") >= support).join(owners, doc).where(F.col("t_docs") <= reach(F.col("e_docs")))
    seldom = held.where(F.col("t_docs") < support).join(close.select(*group, "term").distinct(), "term").join(owners, [*doc, *group])
    together = often.unionByName(seldom).groupBy(*group, "term").agg(
        F.countDistinct("context").alias("contexts"), F.count(F.lit(1)).alias("t_e_docs"), F.max("e_docs").alias("e_docs"),
        F.max("t_docs").alias("t_docs"), F.max("class").alias("class"))
    bits = F.log2(F.col("t_e_docs") * F.lit(n) / (F.col("t_docs") * F.col("e_docs")))
    content = F.log2(F.lit(n) / F.col("e_docs"))
    telling = stored(together.where((content > 0) & (bits >= disclosure * content)).select(*group, "term", "class", "contexts"))
    # for all entities of the group, or for those the term stands close to
    whole = telling.where(F.col("contexts") >= support).withColumns({c: F.lit(None).cast("string") for c in entity}).drop("contexts")
    nearby = telling.where(F.col("contexts") < support).drop("contexts").join(close, [*group, "term"])
    flagged = stored(whole.unionByName(nearby))
    classes = flagged.where(F.col("class").isNull()).select(*group, F.col("term").alias("class"), F.col("kind").alias("kind_"), F.col("value").alias("value_"))
    words = flagged.where(F.col("class").isNotNull())
    same = F.col("kind").isNull() | F.col("kind_").isNull() | ((F.col("kind") == F.col("kind_")) & (F.col("value") == F.col("value_")))
    marked = words.join(classes.withColumn("open", F.lit(True)), [*group, "class"], "left").groupBy(*group, "term").agg(
        F.max(F.when(F.col("open") & same, "remove").otherwise("generalise")).alias("action"))
    return marked.join(owners, group).groupBy(*doc, "term").agg(F.max("action").alias("action"))


def spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Per document with personal data: _id, _tk, base and added, arrays of (start, rank, end, kind, value)."""
    found = stored(mentions(docs))
    base = found.groupBy("_id", "_tk").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "value"))).alias("base"))
    # the words to look for in each document that holds the entity
    sought = stored(disclosing(docs, found, support, disclosure))
    lists = sought.groupBy("_id", "_tk").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("sought"))
    texts = docs.select("text", *row_key()).join(lists, ["_id", "_tk"]).dropDuplicates(["_id", "_tk"])
    words = _words(texts)
    added = words.join(base, ["_id", "_tk"]).where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])))
    added = added.groupBy("_id", "_tk").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS) + 1).cast("long").alias("rank"), "end", F.col("action").alias("kind"), "value"))).alias("added"))
    return base.join(added, ["_id", "_tk"], "left")


def _words(texts: DataFrame) -> DataFrame:
    """The sought words of each text with their places."""
    text = F.col("text")
    cut = texts.select("_id", "_tk", F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("values"), F.split(text, WORDS, -1).alias("gaps"))
    placed = _placed(cut, ["_id", "_tk"]).select("_id", "_tk", "value", "start", "end")
    named = texts.select("_id", "_tk", F.explode("sought").alias("term", "action"))
    return placed.join(named, (placed["_id"] == named["_id"]) & (placed["_tk"] == named["_tk"]) & (F.xxhash64(F.lower(placed["value"])) == named["term"])).select(
        placed["_id"], placed["_tk"], "value", "start", "end", "action")


def _listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets, disclosing terms generalised to their class or removed."""
    doc, tk, found = fresh(docs, "_gf_id", "_gf_tk", "_gf_spans")
    marked = spans(docs).select("_id", "_tk", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))).toDF(doc, tk, found)
    joined = docs.select("*", *[k.alias(n) for k, n in zip(row_key(), (doc, tk))]).join(marked, [doc, tk], "left")

    def put(acc: Column, s: Column) -> Column:
        word = F.when(s["kind"] == "generalise", F.concat(F.substring(s["value"], 1, PREFIX), F.lit("*"))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        # a span inside an earlier one is covered already
        kept = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), word)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), put,
                        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return joined.select(*[F.coalesce(clean, F.col("text")).alias("text") if n == "text" else F.col(f"`{n}`") for n in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    marked = spans(docs)
    keyed = docs.select("doc_id", *row_key()).join(marked, ["_id", "_tk"], "left")
    base = F.coalesce("base", F.array().cast(SPANS))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    both = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(SPANS))))
    return keyed.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(both).alias("spans"))
