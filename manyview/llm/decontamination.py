"""Benchmark decontamination by canonical templates, in Spark's own expressions.

Numbers, in digits or in words, names and units of a text become typed placeholders, a
name of several words one; what is left is its template, so that a question asked anew with other values
keeps most of it. A capital that may only be that of a sentence is read both ways. Windows
of template words are joined with those of the benchmark's items, from every word of
a document on, so that an item of which any window counts cannot be passed over;
items without such a window are looked for as they are, word by word. Documents that
meet an item are then aligned with it: windows that agree are chained in the order of
both texts, over words put in or left out, must cover enough of the item, and equal
values of the item in those windows must stand for equal values in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import row_key

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Around a run of capitals: its first word if that may only be a sentence's, and the words after it.
RUN, FIRST, REST = "\u0004", "\u0005", "\u0006"
MARKS = NAME + NUMBER + UNIT + RUN + FIRST + REST
# Numbers in words in the corpus's languages, English, German, French and Spanish. Words that are also
# articles, units or other common words are left out: "one", "ein", "un", "une", "uno", Spanish "once", French "cent".
SPELLED = {
    2: "two zwei deux dos",
    3: "three drei trois tres",
    4: "four vier quatre cuatro",
    5: "five fünf cinq cinco",
    6: "six sechs seis",
    7: "seven sieben sept siete",
    8: "eight acht huit ocho",
    9: "nine neun neuf nueve",
    10: "ten zehn dix diez",
    11: "eleven elf onze",
    12: "twelve zwölf douze doce",
    13: "thirteen dreizehn treize trece",
    14: "fourteen vierzehn quatorze catorce",
    15: "fifteen fünfzehn quinze quince",
    16: "sixteen sechzehn seize dieciséis",
    17: "seventeen siebzehn diecisiete",
    18: "eighteen achtzehn dieciocho",
    19: "nineteen neunzehn diecinueve",
    20: "twenty zwanzig vingt veinte",
    30: "thirty dreißig trente treinta",
    40: "forty vierzig quarante cuarenta",
    50: "fifty fünfzig cinquante cincuenta",
    60: "sixty sechzig soixante sesenta",
    70: "seventy siebzig setenta",
    80: "eighty achtzig ochenta",
    90: "ninety neunzig noventa",
    100: "hundred hundert cien",
    1000: "thousand tausend mille mil",
}
SPELLED_AS = {word: value for value, spelled in SPELLED.items() for word in spelled.split()}
#: Numbers of two words: tens, and what is added to them.
TENS = [word for word, value in SPELLED_AS.items() if 20 <= value < 100]
ONES = {"one": 1} | {word: value for word, value in SPELLED_AS.items() if value < 10}
# German says both in one word
GERMAN_ONES = ["ein", *(SPELLED[i].split()[1] for i in range(2, 10))]
SPELLED_AS |= {f"{one}und{SPELLED[ten].split()[1]}": ten + i for ten in range(20, 100, 10) for i, one in enumerate(GERMAN_ONES, 1)}


def any_of(words) -> str:
    """A pattern for the longest of the words that fits, by shared beginnings: each letter is tried once."""
    rest = {}
    for word in sorted(set(words), reverse=True):
        rest.setdefault(word[:1], []).append(word[1:])
    ways = [first and first + any_of(more) for first, more in rest.items()]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


WORD_ENDS = r"(?![\p{L}\p{M}])"
#: Never a name, though a sentence may begin with it.
COUNTED = any_of(word.capitalize() for word in SPELLED_AS | ONES) + WORD_ENDS
CAPITAL = rf"(?=\p{{Lu}})(?!{COUNTED})\p{{Lu}}[\p{{Ll}}\p{{M}}]++{WORD_ENDS}"
CAPITALS = rf"{CAPITAL}(?:\s{{1,4}}{CAPITAL})*+"
WITHIN = r"(?<=[\p{L}\p{N},;]\s{1,4})"
#: Names in two ways of reading: capitals within a sentence, after a word or a comma and a little white space; all capitals.
#: Only where a capital stands is it looked at what stands before.
NAME_RE = {"inner": rf"(?=\p{{Lu}}){WITHIN}{CAPITALS}", "every": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}]){CAPITALS}"}
RUN_RE = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}])(?:{WITHIN}{CAPITALS}|({CAPITAL})((?:\s{{1,4}}{CAPITAL})*+))"
NUMBER_RE = r"\p{N}+(?:[.,:]\p{N}+)*"
#: A number in words, in lower case: one word, or tens and ones, by one tree of letters. After a character that is no letter.
AND_ONES = rf"(?:(?:-|\s{{1,4}}){any_of(ONES)}{WORD_ENDS})?"
SPELLED_RE = any_of(word + "+" * (word in TENS) for word in SPELLED_AS).replace("+", WORD_ENDS + AND_ONES) + WORD_ENDS
AFTER_NO_LETTER = rf"([^\p{{L}}\p{{M}}])(?=[{''.join(sorted({word[0] for word in SPELLED_AS}))}]){SPELLED_RE}"
# Units, spelled out or short, after a number.
UNITS = (
    "mm|cm|m|km|in|ft|yd|mi|inch|inches|foot|feet|yards?|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|mg|g|kg|lbs?|oz|grams?|kilograms?|pounds?|ounces?|tons?|"
    "ml|l|lit(?:er|re)s?|gallons?|cups?|s|ms|sec|secs|seconds?|min|mins|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|"
    "usd|eur|gbp|dollars?|euros?|cents?|percent|degrees?|celsius|fahrenheit|mph|kmh|hz|khz|mhz|w|kw|kwh|v|a|b|kb|mb|gb|tb"
)
UNIT_RE = rf"{NUMBER}(\s{{0,4}})(?:{UNITS})(?![\p{{L}}\p{{M}}])"
#: A word of the template, to be read: a name is a mark alone, the first word of other runs has one before it, the rest is one word.
MARKED_WORD = rf"[\p{{L}}\p{{M}}]+|[{NUMBER}{UNIT}]|{RUN}[\p{{L}}\p{{M}}]*|{FIRST}[^{REST}]+{REST}"
PLAIN_WORD = rf"{NUMBER_RE}|[\p{{L}}\p{{M}}]+"
#: A word of the template with its value, in lower case, once names are marked.
VALUE_WORD = rf"{NAME}[^{RUN}]*{RUN}|{NUMBER_RE}|{SPELLED_RE}|[\p{{L}}\p{{M}}]+"
#: Windows of the benchmark that may be sent to every executor: 16 bytes each.
BROADCAST_WINDOWS = 200_000


def unmarked(text: Column) -> Column:
    """The text with a space for each of the characters that serve as marks here."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in MARKS])
    return F.when(odd, F.translate(text, MARKS, " " * len(MARKS))).otherwise(text)


def marked(text: Column) -> Column:
    """The text in lower case, its runs of capitals marked, with placeholders for numbers and units; a space before it."""
    runs = F.lower(F.regexp_replace(unmarked(text), RUN_RE, f"{RUN}$1{FIRST}$2{REST}"))
    numbers = F.concat(F.lit(" "), F.regexp_replace(runs, NUMBER_RE, NUMBER))
    return F.regexp_replace(F.regexp_replace(numbers, AFTER_NO_LETTER, f"$1{NUMBER}"), UNIT_RE, f"{NUMBER}$1{UNIT}")


def marked_words(marked: Column) -> Column:
    """The words of a text that is ``marked``, from which both its templates come."""
    return F.regexp_extract_all(marked, F.lit(MARKED_WORD), 0)


def reading(words: Column, names: str, use=lambda word: word) -> Column:
    """The words of the template of ``marked_words``, and what ``use`` makes of each."""
    first = F.lit(FIRST)
    if names == "every":
        return F.transform(F.filter(words, lambda x: ~F.startswith(x, first)), lambda x: use(F.when(F.startswith(x, F.lit(RUN)), F.lit(NAME)).otherwise(x)))
    name = lambda x: (x == RUN) | F.startswith(x, first)
    return F.transform(words, lambda x: use(F.when(name(x), F.lit(NAME)).when(F.startswith(x, F.lit(RUN)), F.substring(x, 2, 2**31 - 1)).otherwise(x)))


def template(marked: Column, names: str = "inner") -> Column:
    """The words of the template of a text that is ``marked``."""
    return reading(marked_words(marked), names)


def template_values(text: Column, names: str) -> Column:
    """What the words of the template stand for, in lower case; the words of a name with one
    space between, numbers in words as digits."""
    marked_names = F.lower(F.regexp_replace(unmarked(text), NAME_RE[names], f"{NAME}$0{RUN}"))
    number = F.create_map(*[F.lit(x) for pair in (SPELLED_AS | ONES).items() for x in pair])

    def value(v: Column) -> Column:
        name = F.regexp_replace(F.translate(v, NAME + RUN, ""), r"\s+", " ")
        both = F.element_at(number, F.regexp_extract(v, r"^\p{L}+", 0)) + F.element_at(number, F.regexp_extract(v, r"\p{L}+$", 0))
        two_words = F.contains(v, F.lit("-")) | v.rlike(r"\s")
        return (
            F.when(F.startswith(v, F.lit(NAME)), name)
            .when(v.isin(*SPELLED_AS), F.element_at(number, v).cast("string"))
            .when(two_words, both.cast("string"))
            .otherwise(v)
        )

    return F.transform(F.regexp_extract_all(marked_names, F.lit(VALUE_WORD), 0), value)


def plain_words(text: Column) -> Column:
    """All words of a text as they are, but for their case."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD), 0)


def windows(rows: DataFrame, kinds: list[tuple[str, int]], *keep: str) -> DataFrame:
    """A row (``keep``, kind, place, w) for each window: the place of its first word and its
    digest. ``kinds`` names columns of word digests and widths. Each place is a row before its windows
    are made, in compiled code, so that no window is copied."""
    columns, last = list(dict.fromkeys(k for k, _ in kinds)), F.greatest(F.lit(-1), *[F.size(k) - size for k, size in kinds])
    places = rows.select(*keep, *columns, F.explode(F.sequence(F.lit(0), F.when(last >= 0, last))).alias("place"))
    digests = [F.when(F.col("place") <= F.size(k) - size, F.xxhash64(*[F.get(k, F.col("place") + i) for i in range(size)])) for k, size in kinds]
    said = F.array(*[F.lit(f"{k} {size}") for k, size in kinds])
    return places.select(*keep, "place", F.posexplode(F.array(*digests)).alias("turn", "w")).where("w IS NOT NULL").select(*keep, F.get(said, "turn").alias("kind"), "place", "w")


def digested(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def text_windows(keyed: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """The ``windows`` of the column text for each id and row. Its words are found once for both ways of reading."""
    words = keyed.withColumn("words", marked_words(marked(F.col("text"))))
    readings = [reading(F.col("words"), names, F.xxhash64).alias(names) for names in NAME_RE]
    return windows(words.select("id", "row", *readings, digested(plain_words(F.col("text"))).alias("plain")), kinds, "id", "row")


def chains(hits: str, width: Column, reach: Column, drift: Column) -> Column:
    """The longest chains of ``hits``, sorted structs (place, at) of windows that agree: each
    one further in both texts than the one before, with at most ``drift`` words more or
    less between them in one text than in the other; ``reach`` is the item's
    words and ``drift``. Structs (place, at, agreeing, parts, ends): ``parts`` are the
    stretches (shift, first, last) of the item's words, ``ends`` is false for what a longer chain holds."""
    part = "struct<shift:int,first:int,last:int>"
    chain = f"struct<place:int,at:int,agreeing:int,parts:array<{part}>,ends:boolean>"

    def linked(c: Column, h: Column) -> Column:
        return (c["at"] < h["at"]) & (c["place"] < h["place"]) & (F.abs(h["place"] - h["at"] - c["place"] + c["at"]) <= drift)

    def rank(c: Column, h: Column) -> Column:
        # the most windows, then the least turn, then the nearest
        return F.struct(
            c["agreeing"].alias("agreeing"),
            (-F.abs(h["place"] - h["at"] - c["place"] + c["at"])).alias("turn"),
            c["at"].alias("at"),
            c["place"].alias("place"),
            c["parts"].alias("parts"),
        )

    def step(state: Column, h: Column) -> Column:
        # in an array, so that it is computed once
        best = F.array(F.array_max(F.transform(F.filter(state["open"], lambda c: linked(c, h)), lambda c: rank(c, h))))
        return F.get(F.transform(best, lambda b: after(state, h, b)), 0)

    def after(state: Column, h: Column, best: Column) -> Column:
        shift, last = h["place"] - h["at"], F.element_at(best["parts"], -1)
        end = h["at"] + width - 1
        grown = (last["shift"] == shift) & (h["at"] <= last["last"] + 1)
        fresh = F.struct(shift.alias("shift"), F.greatest(h["at"], F.coalesce(last["last"] + 1, h["at"])).alias("first"), end.alias("last")).cast(part)
        longer = F.struct(last["shift"].alias("shift"), last["first"].alias("first"), end.alias("last")).cast(part)
        parts = (
            F.when(best.isNull(), F.array(fresh))
            .when(grown, F.concat(F.slice(best["parts"], 1, F.size(best["parts"]) - 1), F.array(longer)))
            .otherwise(F.concat(best["parts"], F.array(fresh)))
        )
        new = F.struct(
            h["place"].alias("place"), h["at"].alias("at"), (F.coalesce(best["agreeing"], F.lit(0)) + 1).alias("agreeing"), parts.alias("parts"), F.lit(True).alias("ends")
        ).cast(chain)
        # what lies too far back to be linked is done
        near = F.filter(state["open"], lambda c: c["place"] >= h["place"] - reach)
        used = F.transform(
            near,
            lambda c: F.struct(
                c["place"].alias("place"),
                c["at"].alias("at"),
                c["agreeing"].alias("agreeing"),
                c["parts"].alias("parts"),
                (c["ends"] & ~F.coalesce((c["at"] == best["at"]) & (c["place"] == best["place"]), F.lit(False))).alias("ends"),
            ).cast(chain),
        )
        done = F.concat(state["done"], F.filter(state["open"], lambda c: c["ends"] & (c["place"] < h["place"] - reach)))
        return F.struct(F.concat(used, F.array(new)).alias("open"), done.alias("done"))

    none = F.array().cast(f"array<{chain}>")
    return F.aggregate(hits, F.struct(none.alias("open"), none.alias("done")), step, lambda s: F.concat(s["done"], F.filter(s["open"], lambda c: c["ends"])))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 8,
    literal: int = 5,
    cover: float = 0.5,
    drift: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """One row for each document (``id``, ``row``) and item that it holds: ``item``,
    ``covered`` (the share of the item's windows found in order) and ``same`` (true
    if all values are the item's own, false if they are other ones).

    A window counts if ``literal`` of its words are no placeholders. An item is held
    if at least ``cover`` of its windows agree in one chain, with at most ``drift``
    words put in or left out at a time, and no value in those windows stands for two
    different ones. Items of fewer words than ``width`` + 3 are looked for by windows
    of three words, two of them literal. Items of which no window after the first
    counts, such as lists of names, are held if all their words, names and numbers
    included, follow each other in a document. Items of fewer than three words, null
    texts and null items are never found. Two values of an item may become one, as other
    questions may ask for the same number twice. Rows equal in id and text give one
    result, as do items. Numbers in words are numbers up to "ninety-nine", "hundred" and
    "thousand", and never names. Whole texts are read, however long; an empty table or benchmark
    gives an empty result. Windows that many items share are not asked for where an item
    has rarer ones, so that documents meet only items that they can hold. Other columns
    are not read.
    """
    def viewed(rows: DataFrame, said: str, *more: Column) -> DataFrame:
        """``rows`` with the words of the text ``said`` in each way of reading it."""
        readings = [reading(F.col("words"), names).alias(names) for names in NAME_RE]
        kept = [c for c in rows.columns if c != said]
        return rows.withColumn("words", marked_words(marked(F.col(said)))).select(*kept, *readings, plain_words(F.col(said)).alias("plain"), *more)

    def values(said: Column) -> list[Column]:
        return [template_values(said, names).alias(f"{names}_values") for names in NAME_RE]

    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("said")).where("item IS NOT NULL AND said IS NOT NULL").distinct()
    items = viewed(items.withColumn("text_key", F.xxhash64("said")), "said", *values(F.col("said")))
    items = scratch.table(items, "items")
    keyed = docs.select(F.col(doc_id).alias("id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    blank = F.array(F.lit(NAME), F.lit(NUMBER), F.lit(UNIT))

    def of_items(kind: str, chosen: DataFrame, width: int, literal: int) -> DataFrame:
        """(kind, item, at, w) for windows of the column ``kind`` with enough literal words."""
        given = chosen.select("item", "text_key", digested(F.col(kind)).alias(kind), F.col(kind).alias("said"))
        words = F.filter(F.slice("said", F.col("place") + 1, width), lambda x: ~F.array_contains(blank, x))
        return windows(given, [(kind, width)], "item", "text_key", "said").where(F.size(words) >= literal).select("kind", "item", "text_key", F.col("place").alias("at"), "w")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df

    short = F.size("inner") < width + 3
    by_template = [of_items(names, items.where(long), w, least) for names in NAME_RE for long, w, least in ((~short, width, literal), (short, 3, 2))]
    by_template = scratch.table(reduce(DataFrame.unionByName, by_template), "windows")
    # within a sentence only, whether the first word is a name depends on what stands before it
    sure = by_template.where((F.col("at") > 0) | F.startswith("kind", F.lit("every"))).select("item", "text_key").distinct()
    rest = items.join(sure, ["item", "text_key"], "left_anti")
    long = F.size("plain") >= width
    by_word = of_items("plain", rest.where(long), width, 0).unionByName(of_items("plain", rest.where(~long), 3, 0))
    wanted = scratch.table(by_template.unionByName(by_word), "wanted")
    kinds = [(k, int(size)) for k, size in (r["kind"].split(" ") for r in wanted.select("kind").distinct().orderBy("kind").collect())]
    if not kinds:
        return keyed.where("false").select("id", "row", F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("covered"), F.lit(True).alias("same"))
    exact = F.startswith("kind", F.lit("plain"))
    sizes = wanted.groupBy("kind", "item", "text_key").agg(F.count("*").alias("windows"))
    sizes = scratch.table(sizes.withColumn("enough", F.ceil(F.col("windows") * F.when(exact, F.lit(1.0)).otherwise(F.lit(cover)))), "sizes")
    # a document with enough windows of an item has one of any that are more than the rest; the item's rarest ones are asked for
    common = wanted.groupBy("kind", "w").agg(F.count("*").alias("common"))
    turn = F.row_number().over(Window.partitionBy("kind", "item", "text_key").orderBy("common", "at"))
    probes = wanted.join(common, ["kind", "w"]).withColumn("turn", turn).join(sizes, ["kind", "item", "text_key"])
    probes = scratch.table(probes.where(F.col("turn") <= F.col("windows") - F.col("enough") + 1).select("kind", "item", "text_key", "w").distinct(), "probes")
    met = text_windows(keyed, kinds).select("id", "row", "w")
    met = scratch.table(met.join(small(probes.select("w").distinct()), "w").select("id", "row").distinct(), "met")
    texts = keyed.alias("k").join(met.alias("m"), F.expr("k.id <=> m.id AND k.row = m.row"), "left_semi").distinct()
    told = scratch.table(viewed(texts, "text", *values(F.col("text"))), "told")
    here = windows(told.select("id", "row", *[digested(F.col(k)).alias(k) for k in (*NAME_RE, "plain")]), kinds, "id", "row")
    pairs = scratch.table(here.join(small(probes), ["kind", "w"]).select("id", "row", "kind", "item", "text_key").distinct(), "pairs")
    asked = pairs.join(small(wanted), ["kind", "item", "text_key"]).withColumnsRenamed({"id": "p_id", "row": "p_row", "kind": "p_kind", "w": "p_w"})
    agree = here.join(asked, F.expr("id <=> p_id AND row = p_row AND kind = p_kind AND w = p_w"))
    met = agree.groupBy("id", "row", "kind", "item", "text_key").agg(F.array_sort(F.collect_set(F.struct("place", "at"))).alias("hits"), F.count_distinct("at").alias("most"))
    met = met.join(sizes, ["kind", "item", "text_key"]).where(F.col("most") >= F.col("enough"))
    said = [F.when(F.startswith("kind", F.lit(names)), F.struct(F.col(names).alias("words"), F.col(f"{names}_values").alias("values"))) for names in NAME_RE]
    said = F.coalesce(*said, F.struct(F.col("plain").alias("words"), F.col("plain").alias("values")))
    met = met.join(items, ["item", "text_key"]).select("id", "row", "kind", "item", "hits", "windows", "enough", said.alias("asked"))
    size, turn = F.split_part("kind", F.lit(" "), F.lit(2)).cast("int"), F.when(exact, F.lit(0)).otherwise(F.lit(drift))
    lines = met.select("*", F.explode(chains("hits", size, F.size("asked.words") + turn, turn)).alias("line")).drop("hits").where(F.col("line.agreeing") >= F.col("enough"))
    lines = lines.alias("l").join(told.alias("t"), F.expr("l.id <=> t.id AND l.row = t.row")).select("l.*", said.alias("found"))
    # only words within windows that agree were aligned
    places = F.flatten(F.transform("line.parts", lambda p: F.transform(F.sequence(p["first"], p["last"]), lambda i: F.struct(i.alias("i"), (i + p["shift"]).alias("j")))))
    slots = F.filter(places, lambda p: F.array_contains(blank, F.get("asked.words", p["i"])))
    told_as = F.transform(slots, lambda p: F.struct(F.get("asked.values", p["i"]).alias("a"), F.get("found.values", p["j"]).alias("b")))
    # names of equally many words are compared word by word, others by their last words: a run may begin with the first word of a sentence
    a, b = (lambda p: F.split(p["a"], " ")), (lambda p: F.split(p["b"], " "))
    last = lambda p: F.array(F.struct(F.element_at(a(p), -1).alias("a"), F.element_at(b(p), -1).alias("b")))
    each = lambda p: F.zip_with(a(p), b(p), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    words = F.transform(told_as, lambda p: F.when(F.size(a(p)) == F.size(b(p)), each(p)).otherwise(last(p)))
    aligned = (F.size("asked.words") == F.size("asked.values")) & (F.size("found.words") == F.size("found.values"))
    lines = lines.select("id", "row", "item", (F.col("line.agreeing") / F.col("windows")).alias("covered"), F.when(aligned, F.array_distinct(F.flatten(words))).alias("pairs"))
    clash = F.exists("pairs", lambda p: F.exists("pairs", lambda q: (p["a"] == q["a"]) & (p["b"] != q["b"])))
    other = F.exists("pairs", lambda p: p["a"] != p["b"])
    held = lines.where(~F.coalesce(clash, F.lit(False)))
    return held.groupBy("id", "row", "item").agg(F.max("covered").alias("covered"), F.max(~F.coalesce(other, F.lit(False))).alias("same"))
