"""License mentions by ordered signature rules, in Spark's own expressions.

Most texts hold none of the keywords and are done after one look. The words of the others
are taken in blocks that overlap by more than the longest signature. In a block, a rule's
pattern is only tried if the block holds the rule's keyword. A match is marked at both
ends, and the marks' places among the words are its interval. An interval inside another
of higher priority (or of the same and longer) is suppressed, and what is left gives the
labels. As blocks are bounded, time grows with a text's length, however many mentions.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyview.llm.license_rules import BASE, GATE, MOST_WORDS, Rule, rules
from manyview.llm.text_columns import ascii_lower

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULES = "array<struct<keyword:string,rules:array<struct<label:string,pattern:string,priority:int,confidence:double>>>>"
SPAN = "struct<start:int,stop:int,priority:int,label:string,confidence:double>"
BEGIN, END = "\u0001", "\u0002"
#: Words of a block, and those before and after it that it is looked at with: what holds a
#: detection begins at most a signature before it, and ends at most one behind it.
BLOCK, BEFORE, AFTER = 512, 2 * MOST_WORDS, 2 * MOST_WORDS


def joined_words(text: Column) -> Column:
    """The words, lower case, each with a space before and after it."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(ascii_lower(text), BETWEEN, " ")), F.lit(" "))


def places(words: Column, pattern: Column) -> Column:
    """Where a pattern's matches begin and end, in words from 0 on: structs (start, stop)."""
    # a space is looked at but not taken on either side, so that neighbours both match
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    marked = F.filter(F.array(F.regexp_replace(words, whole, F.lit(f"{BEGIN}$0{END}"))), lambda m: F.contains(m, F.lit(BEGIN)))
    # one array of words at most, in an array so that it is computed once
    split = F.transform(marked, lambda m: F.split(F.btrim(m), " "))
    begins = F.transform(split, lambda w: F.filter(F.transform(w, lambda t, i: F.when(F.startswith(t, F.lit(BEGIN)), i)), lambda i: i.isNotNull()))
    ends = F.transform(split, lambda w: F.filter(F.transform(w, lambda t, i: F.when(F.endswith(t, F.lit(END)), i + 1)), lambda i: i.isNotNull()))
    return F.flatten(F.zip_with(begins, ends, lambda b, e: F.zip_with(b, e, lambda x, y: F.struct(x.alias("start"), y.alias("stop")))))


def holding(found: Column) -> Column:
    """Detections that lie in no other of higher priority, or of the same and longer.

    In order of their start, the longest first, what a detection can lie in comes
    before it; of that, only what reaches beyond its start is looked at.
    """

    def rank(s: Column) -> Column:
        return F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), (-s["priority"]).alias("c"), s.alias("span"))

    ordered = F.transform(F.array_sort(F.transform(found, rank)), lambda r: r["span"])
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, own: Column) -> Column:
        open_ = F.filter(acc["open"], lambda o: o["stop"] > own["start"])
        longer = lambda o: (o["stop"] - o["start"]) > (own["stop"] - own["start"])
        inside = F.exists(
            open_,
            lambda o: (o["stop"] >= own["stop"]) & ((o["priority"] > own["priority"]) | ((o["priority"] == own["priority"]) & longer(o))),
        )
        return F.when(inside, F.struct(open_.alias("open"), acc["out"].alias("out"))).otherwise(
            F.struct(F.concat(open_, F.array(own)).alias("open"), F.concat(acc["out"], F.array(own)).alias("out"))
        )

    return F.aggregate(ordered, F.struct(none.alias("open"), none.alias("out")), step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, carry: list[str], *, table: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Columns ``carry`` of every row, with ``__lic_words`` (number of words),
    ``__lic_base`` (places of the base phrases), ``__lic_first`` and ``__lic_last``
    (their smallest and largest start, in words from 0, or null), ``__lic_base_labels``
    and ``__lic_labels`` (sorted, joined by commas; empty if none), ``__lic_spans``
    (the detections that hold, in words from 0 on) and ``__lic_score``
    (the highest confidence, a base phrase counting 0.7; 0 if nothing is found).

    A null text is an empty one. A detection inside another of the same interval and
    priority stays beside it. Matches of one rule do not overlap; in texts of more than a
    block they are taken from the block in which they begin. Rows are independent: repeated
    rows repeat, and an empty table gives an empty result. Columns of ``docs`` beside ``carry`` are not read;
    names that begin with ``__lic_`` are reserved. Nothing is shuffled.
    """
    by_keyword: dict[str, list[dict]] = {}
    for r in rules() if table is None else table:
        by_keyword.setdefault(r.keyword, []).append(asdict(r))
    known = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": rs} for k, rs in by_keyword.items()])), RULES)
    some = F.coalesce(F.col(text), F.lit(""))
    lower = F.lower(some)
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(lower, F.lit(word))
    looked = docs.select(
        *[F.col(c) for c in carry],
        F.coalesce(F.regexp_count(some, F.lit(UPPER_TOKEN)), F.lit(0)).cast("long").alias("__lic_words"),
        F.when(gate, joined_words(some)).alias("__lic_joined"),
    )
    words = F.col("__lic_joined")

    def phrase_at(phrase: str, label: str) -> Column:
        return F.transform(places(words, F.lit(phrase)), lambda s: F.struct(s["start"].alias("start"), F.lit(label).alias("label")))

    base = [phrase_at(*b) for b in BASE]
    hit = looked.withColumn("__lic_base_at", F.when(words.isNotNull(), F.concat(*base)).otherwise(F.array().cast("array<struct<start:int,label:string>>")))
    hit = hit.withColumn("__lic_split", F.when(words.isNotNull(), F.split(F.btrim(words), " ")))

    def detections(begin: Column) -> Column:
        """What holds among the detections of the block that begins at word ``begin``."""
        first = F.greatest(begin - BEFORE, F.lit(0))
        block = F.concat(F.lit(" "), F.array_join(F.slice("__lic_split", first + 1, begin - first + BLOCK + AFTER), " "), F.lit(" "))
        return F.flatten(F.transform(F.array(block), lambda said: of_block(said, first, begin)))

    def of_block(said: Column, first: Column, begin: Column) -> Column:
        tried = F.flatten(F.transform(F.filter(known, lambda g: F.contains(said, g["keyword"])), lambda g: g["rules"]))
        found = F.flatten(F.transform(tried, lambda r: F.transform(places(said, r["pattern"]), lambda s: span(s, r, first))))
        return F.filter(holding(found), lambda s: (s["start"] >= begin) & (s["start"] < begin + BLOCK))

    def span(s: Column, r: Column, first: Column) -> Column:
        own = [(s["start"] + first).alias("start"), (s["stop"] + first).alias("stop")]
        return F.struct(*own, *[r[c].alias(c) for c in ("priority", "label", "confidence")])

    none = F.array().cast(f"array<{SPAN}>")
    begins = F.transform(F.sequence(F.lit(0), F.floor((F.size("__lic_split") - 1) / F.lit(BLOCK)).cast("int")), lambda j: j * BLOCK)
    hit = hit.withColumn("__lic_spans", F.when(words.isNotNull(), F.flatten(F.transform(begins, detections))).otherwise(none))
    starts = F.transform("__lic_base_at", lambda s: s["start"].cast("long"))
    names = F.concat(F.transform("__lic_base_at", lambda s: s["label"]), F.transform("__lic_spans", lambda s: s["label"]))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.greatest(F.array_max(F.transform("__lic_spans", lambda s: s["confidence"])), F.when(F.size("__lic_base_at") > 0, F.lit(0.7)))
    return hit.select(
        *[F.col(c) for c in carry],
        "__lic_words",
        F.size("__lic_base_at").cast("long").alias("__lic_base"),
        F.array_min(starts).alias("__lic_first"),
        F.array_max(starts).alias("__lic_last"),
        listed(F.transform("__lic_base_at", lambda s: s["label"])).alias("__lic_base_labels"),
        listed(names).alias("__lic_labels"),
        "__lic_spans",
        F.coalesce(sure, F.lit(0.0)).alias("__lic_score"),
    )
