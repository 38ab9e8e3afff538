"""Personal data: base spans by pattern, and information-theoretic sanitisation of terms.

DataFrame functions only. E-mail addresses, IP addresses, card numbers and phone numbers
are found with their spans. Then the corpus tells which other terms give such an entity
away (public method: Sanchez and Batet, "C-sanitized", 2016): for a term t near entity e,
the pointwise mutual information log2(P(e|t) / P(e)) over distinct texts is set against
the entity's information log2(1 / P(e)). P(e|t) is (n_te + prior * P(e)) / (n_t + prior),
so few common texts are weaker evidence than many. A pair counts only where its common texts
are more than chance gives: the chance of n_te or more of n_t texts, were the two
independent, is at most exp(-n_t KL(n_te / n_t, P(e))) (Chernoff), and over all pairs of the
corpus these are allowed to sum to ``chance``. So one rare word beside one entity, in a
single text, tells nothing; the same two in several texts do. A term that discloses at least
``generalise`` becomes a placeholder in texts with that entity, and one that discloses at
least ``remove`` is removed.

Entities are counted at the levels that texts have in common: whole (cards and phones by
their digits, IP addresses without leading zeros), by part (e-mail domains and the words of
the local part, the first six digits of cards, the first four of phones, the first three
numbers of IP addresses), and by kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need, sized_join, unwrap, wrapped

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the plain patterns, in linear time: a run of characters is tried once, from its start or from the end of the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
TERM = r"\p{L}{3,}"
#: Code points on either side of an entity in which terms count as near.
WINDOW = 60


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2).cast("int") % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int")),
    )
    return F.length(digits).between(14, 19) & (total % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _found(text: Column, pattern: Column, order: int, valid) -> Column:
    """Spans of all valid matches: what lies between matches, and the matches, give the places."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & valid(x["hit"]), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")), step)["spans"]


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by start and then kind; null texts have none."""
    none = F.array().cast(SPAN)
    each = [F.when(text.rlike(GUARDS[k]), _found(text, F.lit(PATTERNS[k]), i, lambda v, k=k: _valid(k, v))).otherwise(none) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _context(text: Column, span: Column) -> Column:
    """Lower-case terms within the window on either side, whole words only: a word that the window cuts is left out."""
    # One more code point shows whether the window begins or ends inside a word.
    left = F.when(span["start"] > WINDOW, F.regexp_replace(F.substring(text, span["start"] - WINDOW, F.lit(WINDOW + 1)), r"^\S+", "")).otherwise(F.substring(text, F.lit(1), span["start"]))
    right = F.substring(text, span["end"] + 1, F.lit(WINDOW + 1))
    right = F.when(F.length(right) > WINDOW, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
    return _terms(F.concat(left, F.lit(" "), right))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _levels(span: Column) -> Column:
    """What an entity counts as; the kind comes first."""
    value = F.lower(span["value"])
    digits, is_kind = _digits(value), lambda k: span["kind"] == KINDS.index(k)
    mail = F.concat(F.array(value, F.regexp_replace(value, "^[^@]*", "")), F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit(TERM), F.lit(0)))
    plain = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
    part = lambda c: F.concat(c, F.lit("*"))
    levels = F.when(is_kind("email"), mail).when(is_kind("ip"), F.array(plain, part(F.regexp_replace(plain, "[0-9]+$", ""))))
    levels = levels.when(is_kind("card"), F.array(digits, part(F.substring(digits, 1, 6)))).otherwise(F.array(digits, part(F.substring(digits, 1, 4))))
    levels = F.concat(levels, F.array(F.lit("*")))
    return F.array_distinct(F.transform(levels, lambda v: F.concat(span["kind"].cast("string"), F.lit(":"), v)))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: ``doc_id, key, spans, near, words``; ``key`` is the text's MD5, ``near`` pairs each entity with its terms, ``words`` has all terms of texts with an entity."""
    rows = need(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    near = F.transform("spans", lambda s: F.struct(_levels(s).alias("entities"), _context(F.col("text"), s).alias("terms")))
    words = F.when(F.size("spans") > 0, _terms(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return materialize(rows.select("doc_id", F.md5("text").alias("key"), "spans", near.alias("near"), words.alias("words")), "scan")


def _evidence(n_te: Column, n_t: Column, share: Column) -> Column:
    """n_t KL(n_te / n_t, share): minus the logarithm of a bound on the chance of so many common texts; 0 if they are no more than expected."""
    p = n_te / n_t
    rest = F.when(n_te < n_t, (n_t - n_te) * F.ln((1 - p) / (1 - share))).otherwise(0.0)
    return F.when(p > share, n_te * F.ln(p / share) + rest).otherwise(0.0)


def disclosures(docs: DataFrame, scanned: DataFrame, generalise: float, remove: float, prior: float, chance: float) -> DataFrame:
    """``entity, term, n_te, n_t, disclosure, removed`` for the terms over the threshold and beyond chance.

    Texts count once however often they are copied: copies are no further evidence. Terms
    that can't reach the threshold or the evidence, as they are near entities in too many
    texts, leave before the corpus is counted: both fall as n_t grows.
    """
    texts = float(max(scanned.select("key").distinct().count(), 1))
    pairs = scanned.select("key", F.explode("near").alias("x")).select("key", F.explode("x.entities").alias("entity"), "x.terms")
    entities = pairs.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    near = pairs.select("key", "entity", F.explode("terms").alias("term")).distinct()
    both = materialize(near.groupBy("entity", "term").agg(F.count("*").alias("n_te")), "common")
    least = math.log(max(both.count(), 1) / chance)
    seen = near.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    share = F.col("n_e") / texts  # an entity in every text has no information to disclose
    given = lambda n_t: (F.col("n_te") + prior * share) / (F.col(n_t) + prior)
    beyond = lambda n_t: _evidence(F.col("n_te"), F.col(n_t), share) >= least * (1 - 1e-9)
    # A term is in as many texts as it is near some entity, so one that is common there can't reach the threshold.
    both = sized_join(sized_join(both, materialize(entities, "entities"), "entity", "inner"), materialize(seen, "seen"), "term", "inner").where(F.col("n_e") < texts)
    both = materialize(both.where(beyond("n_near") & (given("n_near") >= F.pow(share, F.lit(1 - generalise)) * (1 - 1e-9))).drop("n_near"), "pairs")
    terms = materialize(both.select("term").distinct(), "terms")
    words = need(docs, ["text"]).where("text IS NOT NULL")
    if terms.isEmpty():
        words = words.limit(0)  # no pair can reach it, so nothing needs to be counted
    # Each of n copies counts 1/n, so sums by term alone leave a task and no (text, term) pair is shuffled.
    copied = materialize(scanned.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    words = sized_join(words.withColumn("key", F.md5("text")), copied, "key", "left")
    words = words.select(F.explode(_terms(F.col("text"))).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("part"))
    counted = sized_join(words, terms, "term", "left_semi").groupBy("term").agg(F.round(F.sum("part")).alias("n_t"))
    rated = sized_join(both, materialize(counted, "counted"), "term", "inner").where(beyond("n_t")).withColumn("disclosure", 1 - F.log2(given("n_t")) / F.log2(share))
    return materialize(rated.where(F.col("disclosure") >= generalise).select("entity", "term", "n_te", F.col("n_t").cast("long").alias("n_t"), "disclosure", (F.col("disclosure") >= remove).alias("removed")), "disclosures")


def _term_spans(text: Column, terms: Column) -> Column:
    one = lambda t: _found(text, F.concat(F.lit(r"(?iu)(?<!\p{L})\Q"), t["term"], F.lit(r"\E(?!\p{L})")), 4, lambda v: F.lit(True))
    each = F.transform(terms, lambda t: F.transform(one(t), lambda s: F.struct(s["start"].alias("start"), F.when(t["removed"], 5).otherwise(4).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return F.array_sort(F.flatten(each).cast(SPAN))


def term_spans(docs: DataFrame, scanned: DataFrame, found: DataFrame) -> DataFrame:
    """``key, terms``: for each distinct text that holds an entity with disclosing terms, their spans outside the base ones."""
    # By the text's own terms, as an entity in many texts would pair each of them with all its terms.
    wanted = scanned.where(F.size("near") > 0).select("key", F.flatten("near.entities").alias("entities"), F.explode("words").alias("term"))
    wanted = sized_join(wanted, found, "term", "inner").where("array_contains(entities, entity)").groupBy("key", "term").agg(F.max("removed").alias("removed"))
    wanted = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("term", "removed")).alias("wanted")), "wanted")
    texts = need(docs, ["text"]).withColumn("key", F.md5("text"))
    met = sized_join(texts, wanted, "key", "inner").withColumn("base", base_spans(F.col("text")))
    clear = F.filter(_term_spans(F.col("text"), F.col("wanted")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return materialize(met.select("key", clear.alias("terms")).groupBy("key").agg(F.first("terms").alias("terms")), "terms")


#: How a span shows in lists of spans and in sanitised texts, by kind.
NAMES = (*KINDS, "term", "removed")
PLACES = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


class Sanitiser:
    """Spans of one table of documents; ``generalise`` and ``remove`` are shares of the entity's information, ``prior`` counts as so many texts that hold a term and the entity by chance alone, ``chance`` is how many pairs of the whole corpus may pass by chance."""

    def __init__(self, docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, prior: float = 1.0, chance: float = 0.05):
        self.docs = docs
        self.scanned = scan(docs)
        self.found = disclosures(docs, self.scanned, generalise, remove, prior, chance)
        self.terms = term_spans(docs, self.scanned, self.found)

    def spans(self) -> DataFrame:
        """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms``, one row per input row.

        Null texts count as empty; they have no spans, so the digest of the empty string.
        Null doc_ids stay, repeated rows each give a row, further columns are not read, and an
        empty table gives an empty result.
        """
        rows = sized_join(self.scanned, self.terms, "key", "left")
        counts = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
        terms = F.coalesce("terms", F.array().cast(SPAN))
        return rows.select("doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("spans", terms))).alias("spans"), F.size(terms).cast("long").alias("n_terms"))

    def sanitised(self) -> DataFrame:
        """The documents, all columns, with placeholders for their spans.

        Texts without a span stay as they are, and so do null texts; repeated rows are all
        changed alike; columns may have any names; an empty table gives an empty result.
        """
        named = self.docs.select(wrapped(self.docs).alias("row"), "text", F.md5("text").alias("key"))
        rows = sized_join(named, self.terms, "key", "left").withColumn("spans", F.array_sort(F.concat(base_spans(F.col("text")), F.coalesce("terms", F.array().cast(SPAN)))))
        places = F.array(*map(F.lit, PLACES))
        text = F.col("text")

        def step(acc, s):
            fresh = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(places, s["kind"] + 1)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"))

        done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step)
        clean = F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))
        new = F.when(F.size("spans") > 0, clean).otherwise(text)
        return unwrap(rows.select(F.col("row").withField("text", new).alias("row")), "row", self.docs.columns)
