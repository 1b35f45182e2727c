"""PII: pattern spans, and information-theoretic sanitisation of revealing terms.

All of it is DataFrame expressions. Patterns give positions without Python: the
text is split at a pattern's matches, so a match starts after the lengths of the
gaps and matches before it. The patterns are written with possessive runs and
anchored to the start of a run (or the end of the match before), which finds the
same leftmost matches in time linear in the text.

Terms: each value found (an e-mail, a number) is a protected entity. For a term t
in a document of an entity e the corpus gives PMI(t; e) and the entity's
information IC(e) = -log2 p(e); their ratio is the share of the entity's
information that t discloses (C-sanitised; Sanchez & Batet, 2016). Every pair is
scored, once-seen ones too. p(e|t) is smoothed towards p(e) with the weight of
``PRIOR`` contexts against the number of different contexts of the pair, so few
contexts lower the share instead of excluding the pair. The context is the whole
document, and copies of one text are one context. Terms are runs of letters,
marks and digits of any length, joined by hyphens or apostrophes, but not parts
of addresses. p counts all documents.

A term is generalised (to its wider class: a name, word, number or code) where its
share reaches ``GENERALISE`` and removed where it reaches ``REMOVE``, in the
documents of the entities it discloses. Elsewhere it stays: a document that doesn't
hold the entity says nothing about it, and common words that a group of near copies
shares with an address would be masked in all documents of the corpus.
``elsewhere`` asks for that stricter rule.

Defined cases: null text is empty and has no spans; kinds may overlap, spans of a
kind don't; overlapping spans are masked as one; null ids are kept; repeated
rows each get their spans; other columns are kept by ``sanitise``, whose result
has the input's columns. Texts are never shuffled unless more than
``BROADCAST_BYTES`` of spans are to be joined to them, and then only those that can have any. A text with n matches costs n * sqrt(n)
small steps at most; no step copies what it has made so far for each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
GENERALISE, REMOVE, PRIOR = 0.8, 0.95, 1.0
#: Bytes of a table, as text, up to which it is broadcast instead of shuffled.
BROADCAST_BYTES = 8 << 20

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold, a character or a pattern, for a kind to be tried.
_NEEDS = {"email": "@", "ip": "[.][0-9]+[.][0-9]+[.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": "+"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
_TERM = r"(?<![\p{L}\p{M}\p{N}@._%+-])[\p{L}\p{M}\p{N}]++(?:[-'’][\p{L}\p{M}\p{N}]++)*+(?![@_%+-])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, doubled at every second from the right, sum to a multiple of 10."""
    digits = F.split(F.reverse(_digits(value)), "")
    plain = lambda c: c.cast("int")
    doubled = lambda c: F.substring(F.lit("0246813579"), c.cast("int") + 1, F.lit(1)).cast("int")
    parts = F.transform(digits, lambda c, i: F.when(i % 2 == 0, plain(c)).otherwise(doubled(c)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _matches(kind: str) -> Column:
    t = F.col("t")
    need = _NEEDS[kind]
    may = F.contains(t, F.lit(need)) if len(need) == 1 else t.rlike(need)
    return F.when(may, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column, op, zero: int = 0) -> Column:
    """For each place of an array of longs, ``op`` over all values before it.

    Arrays only grow by copies, so the values are cut into blocks of the root of
    their number: n values cost about n * sqrt(n) copied longs, not n * n."""
    first = F.lit(zero).cast("long")

    def grow(array: Column, start: Column, value) -> Column:
        return F.aggregate(array, F.array(start), lambda done, x: F.concat(done, F.array(value(F.element_at(done, -1), x))))

    def scan(v: Column) -> Column:
        def cut_by(b: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / b).cast("int") - 1), lambda k: F.slice(v, k * b + 1, b))

            def joined(parts: Column) -> Column:
                bases = F.slice(grow(parts, first, lambda a, part: F.aggregate(part, a, op)), F.lit(1), F.size(parts))
                return F.flatten(F.zip_with(parts, bases, lambda part, base: F.slice(grow(part, base, op), F.lit(1), F.size(part))))

            return _let(blocks, joined)

        return F.when(F.size(v) > 0, _let(F.ceil(F.sqrt(F.size(v))).cast("int"), cut_by)).otherwise(F.array().cast("array<bigint>"))

    return _let(values.cast("array<bigint>"), scan)


def _places(found: Column, pattern: str) -> Column:
    """Spans (start, end, value) of all matches ``found`` of a pattern in the text ``t``,
    by the gaps between them."""

    def spans(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(F.col("t"), pattern, -1), F.lit(1), F.size(m)), lambda g: F.length(g).cast("long"))

        def placed(g: Column) -> Column:
            before = _scan(F.zip_with(g, m, lambda x, v: x + F.length(v)), lambda a, x: a + x)
            starts = F.zip_with(before, g, lambda a, x: a + x)
            return F.zip_with(starts, m, lambda at, v: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value")))

        return F.when(F.size(m) > 0, _let(gaps, placed)).otherwise(F.array().cast(_SPAN))

    return _let(found, spans)


def _located(kind: str, found: Column) -> Column:
    return F.filter(_places(found, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def _terms() -> Column:
    """Distinct terms of the text ``t``, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(_TERM), F.lit(0))), F.lower))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), spans (kind, start, end, value) by kind and
    start, terms (of texts with spans). Code points, end exclusive."""
    rows = _texts(docs).select("doc_id", "t", *(_matches(k).alias(f"m_{k}") for k in KINDS))
    rows = rows.select("doc_id", "t", *(_located(k, F.col(f"m_{k}")).alias(f"s_{k}") for k in KINDS))

    def part(kind: str) -> Column:
        return F.transform(F.col(f"s_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    parts = [part(k) for k in KINDS]
    rows = rows.select("doc_id", "t", F.xxhash64("t").alias("h"), F.concat(*parts).alias("spans"))
    return rows.select("doc_id", "h", "spans", F.when(F.size("spans") > 0, _terms()).alias("terms"))


def _shares(total: int):
    """The share of an entity's information that a term discloses, as a Column of counts."""
    p_e = F.col("n_e") / F.lit(float(max(total, 1)))

    def share(n_te: Column, n_t: Column, contexts: Column) -> Column:
        given = (contexts * n_te / n_t + PRIOR * p_e) / (contexts + PRIOR)
        return F.when(F.col("n_e") < total, 1 - F.log2(given) / F.log2(p_e)).otherwise(F.lit(0.0))

    return share


def revealing_terms(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, min_contexts: int = 1, elsewhere: int | None = None) -> DataFrame | None:
    """(doc_id, h, term, kind): the terms to mask in each document; None where no term
    discloses an entity. Counts are over all documents; ``min_contexts`` is for
    callers who want pairs of few contexts left out, ``elsewhere`` for those who want
    a term masked in documents without the entity, too, from so many contexts on."""
    seen = found.filter(F.size("spans") > 0).select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "spans", "terms")
    entities = F.array_distinct(F.transform("spans", lambda s: F.sha2(F.lower(F.concat_ws(":", s["kind"], s["value"])), 256)))
    holds = seen.select("row", F.explode(entities).alias("entity"))
    # Entities of the same documents have the same counts with every term: one of them stands for all.
    entity = holds.groupBy("entity").agg(F.count("*").alias("n_e"), F.min("row").alias("low"), F.max("row").alias("high"), F.bit_xor(F.xxhash64("row")).alias("rows"))
    entity = entity.groupBy("n_e", "low", "high", "rows").agg(F.min("entity").alias("entity"))
    total = docs.count()
    share = _shares(total)

    # A term is in as many documents as it is in with any entity, at least; that bounds
    # its share from above, and terms of the common language go before pairs are counted.
    near = seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    most = F.least("n_e", "n_near")
    held_by = holds.join(entity.select("entity", "n_e"), "entity").groupBy("row").agg(F.collect_list(F.struct(F.xxhash64("entity").alias("entity"), "n_e")).alias("held"))
    words = seen.join(held_by, "row").select("row", "doc_id", "h", "held", F.explode("terms").alias("term")).join(near, "term")
    pairs = cut(words.select("row", "doc_id", "h", "term", "n_near", F.inline("held")).filter(share(most, F.col("n_near"), most) >= generalise))
    both = pairs.groupBy("term", "entity", "n_e", "n_near", "h").agg(F.count("*").alias("n")).groupBy("term", "entity", "n_e", "n_near").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts"))
    both = cut(both.filter((F.col("contexts") >= min_contexts) & (share(F.col("n_te"), F.col("n_near"), F.col("contexts")) >= generalise)))
    if both.isEmpty():
        return None
    # Terms are counted over all texts, with partial counts before the shuffle.
    n_t = _texts(docs).select(F.explode(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    scored = both.join(n_t, "term").withColumn("share", share(F.col("n_te"), F.col("n_t"), F.col("contexts"))).filter(F.col("share") >= generalise)
    scored = cut(scored.select("term", "entity", "contexts", "share"))
    if scored.isEmpty():
        return None
    masks = pairs.join(_few(scored), ["term", "entity"]).select("doc_id", "h", "term", "share")
    if elsewhere is not None:
        wide = cut(scored.filter(F.col("contexts") >= elsewhere).groupBy("term").agg(F.max("share").alias("share")))
        uses = _texts(docs).select("doc_id", F.xxhash64("t").alias("h"), F.explode(_terms()).alias("term"))
        masks = masks.unionByName(uses.join(_few(wide), "term").select("doc_id", "h", "term", "share"))
    masks = masks.groupBy("doc_id", "h", "term").agg(F.max("share").alias("share"))
    return masks.select("doc_id", "h", "term", F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("kind"))


def _is_small(df: DataFrame) -> bool:
    """Whether the rows, written out, take ``BROADCAST_BYTES`` at most, whatever they hold."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _is_small(df) else df


def _may_hold(t: Column) -> Column:
    """Whether a text can have a span of a pattern; false for most texts without one."""
    return F.contains(t, F.lit("@")) | t.rlike(_NEEDS["ip"]) | t.rlike("(?:[0-9][ -]?){16}") | t.rlike("[+][0-9]")


def _listed(places: Column, terms: Column) -> Column:
    """(kind, start, end) of the places whose word is one of ``terms`` (term, kind).
    The terms are dealt into as many lists as the root of their number by a hash, so
    that a word is looked for in one short list."""

    def dealt(n: Column) -> Column:
        slot = lambda x: F.pmod(F.xxhash64(x), n.cast("long")).cast("int")
        lists = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(terms, lambda x: slot(x["term"]) == k))

        def found(by: Column) -> Column:
            def hit(p: Column) -> Column:
                word = F.lower(p["value"])
                return _let(F.filter(F.element_at(by, slot(word) + 1), lambda x: x["term"] == word), lambda f: F.when(F.size(f) > 0, F.struct(f[0]["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))

            return F.filter(F.transform(places, hit), lambda x: x.isNotNull())

        return _let(lists, found)

    return _let(F.ceil(F.sqrt(F.size(terms))).cast("int"), dealt)


def term_spans(docs: DataFrame, masks: DataFrame, everywhere: bool = False) -> DataFrame:
    """(doc_id, h, more): places of each document's terms, as whole words, any case.
    ``everywhere``: documents without a pattern's span may have terms, too."""
    kept = masks.groupBy("doc_id", "h").agg(F.collect_list(F.struct("term", "kind")).alias("terms"))
    kept = cut(kept.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "terms"))
    texts = _texts(docs) if everywhere else _texts(docs).filter(_may_hold(F.col("t")))
    rows = texts.withColumn("h", F.xxhash64("t")).join(_few(kept), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")))
    # One pass over the words of a text for all its terms; each word with its place.
    words = _places(F.regexp_extract_all("t", F.lit(_TERM), F.lit(0)), _TERM)
    more = _let(words, lambda w: _listed(w, F.col("terms")))
    return rows.select("doc_id", "h", F.sort_array(more).alias("more")).dropDuplicates(["doc_id", "h"])


def _free(base: Column, more: Column) -> Column:
    """The spans of ``more`` that meet none of ``base``, in one sweep over both by start."""
    tagged = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.transform(more, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))),
    )
    far = 1 << 62

    def sweep(all_: Column) -> Column:
        before = _scan(F.transform(all_, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(F.lit(0))), lambda a, x: F.greatest(a, x))
        after = F.reverse(_scan(F.reverse(F.transform(all_, lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(F.lit(far)))), lambda a, x: F.least(a, x), far))
        meets = F.zip_with(before, after, lambda low, high: F.struct(low.alias("low"), high.alias("high")))
        kept = F.zip_with(all_, meets, lambda x, m: F.when((x["rank"] == 1) & (m["low"] <= x["start"]) & (m["high"] >= x["end"]), F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
        return F.sort_array(F.filter(kept, lambda x: x.isNotNull()))

    return _let(F.array_sort(tagged), sweep)


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, h, spans (kind, start, end): patterns' spans, then terms' spans."""
    found = cut(base_spans(docs))
    terms = revealing_terms(docs, found, **thresholds)
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if terms is None:
        return found.select("doc_id", "h", base.alias("spans"), F.size("spans").alias("n_base"))
    more = term_spans(docs, terms, thresholds.get("elsewhere") is not None).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "more")
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    # A term inside a pattern's span is covered already.
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    free = F.when(F.size("more") > 0, F.when(F.size("spans") > 0, _free(base, F.col("more"))).otherwise(F.col("more"))).otherwise(none)
    return both.select("doc_id", "h", F.concat(base, F.coalesce(free, none)).alias("spans"), F.size("spans").alias("n_base"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.slice("spans", F.lit(1), F.col("n_base"))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _class(value: Column) -> Column:
    """The wider class that stands for a term: by what kind of word it is as written."""
    first = F.substring(value, 1, 1)
    return (
        F.when(value.rlike("^[0-9]+$"), F.lit("[NUMBER]")).when(value.rlike(r"\p{N}"), F.lit("[CODE]"))
        .when(first != F.lower(first), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by its first span's mask.

    Pieces are cut from the text in 32 bits a character, where a place is an offset."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    masks = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])

    def cut_out(wide: Column) -> Column:
        def piece(low: Column, high: Column) -> Column:
            """Characters low .. high - 1; the mark before them keeps a text's own mark from being read as one."""
            return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(wide, (4 * low + 1).cast("int"), (4 * (high - low)).cast("int"))), "UTF-32")

        def joined(s: Column) -> Column:
            ends = _scan(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
            parts = F.zip_with(s, ends, lambda x, done: F.when(x["start"] >= done, F.concat(piece(done, x["start"]), F.when(x["kind"] == "generalise", _class(piece(x["start"], x["end"]))).otherwise(F.element_at(masks, x["kind"])))).otherwise(F.lit("")))
            last = F.array_max(F.transform(s, lambda x: x["end"]))
            return F.concat(F.array_join(parts, ""), piece(last, F.length(wide) / 4))

        return _let(ordered, joined)

    return _let(F.encode(text, "UTF-32"), cut_out)


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with their spans masked; ``n_chars``, where there is one, follows the text."""
    found = find(docs, **thresholds).filter(F.size("spans") > 0)
    found = cut(found.select(F.col("doc_id").alias("__pii_id"), F.col("h").alias("__pii_h"), F.col("spans").alias("__pii_spans")).dropDuplicates(["__pii_id", "__pii_h"]))
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__pii_id")) & (F.xxhash64(plain) == F.col("__pii_h"))
    few = _is_small(found)
    if few or thresholds.get("elsewhere") is not None:
        both = docs.join(F.broadcast(found) if few else found, same, "left")
    else:  # only texts that can have spans are shuffled
        rest = docs.filter(~_may_hold(plain)).withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in found.columns})
        both = docs.filter(_may_hold(plain)).join(found, same, "left").unionByName(rest)
    text = F.when(F.col("__pii_spans").isNotNull(), _masked(F.col("text"), F.col("__pii_spans"))).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__pii_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: personal data and revealing terms masked in every document."""
    return sanitise(docs)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the query that SQL can express."""
    return query(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in KINDS))


ORACLE_COUNTS = r"""
WITH m AS (SELECT doc_id,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
    regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
    list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
  FROM documents)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda x: coalesce(list_bool_and(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false))), false)))::BIGINT AS n_ip,
  len(list_filter(list_filter(card, lambda d: len(d) BETWEEN 16 AND 19), lambda d: list_sum(list_transform(range(1, len(d) + 1), lambda i:
    CASE WHEN (len(d) - i) % 2 = 0 THEN d[i::INT]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][d[i::INT]::INT + 1] END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda d: len(d) BETWEEN 8 AND 15))::BIGINT AS n_phone
FROM m
"""
