"""Decontamination, web pages, licenses, mixing and search against plain Python."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import plain
import plain_templates
import pyarrow as pa
import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from manyview.llm import registry
from manyview.llm.decontamination import leaks, marked, template, template_values, text_windows
from manyview.llm.html_text import Page, core, extract_text, main_text
from manyview.llm.license_rules import GATE, MOST_WORDS, rules
from manyview.llm.license_scan import scan_licenses
from manyview.llm.mixing import mix_sources
from manyview.llm.topk_search import Shard, top_k

# --- benchmark ---

QUESTION = (
    "A baker named Alice sells 12 loaves of bread for 3 dollars each morning. Then Alice buys 5 kg of flour and pays 4 dollars for every kg. "
    "How much money does the baker have left when the market closes?"
)
SHORT = "Which river crosses seven capitals today?"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0, "i", "r", "w", 1, "c", "g", "p") for i, t in rows], SCHEMA)


def test_template(spark):
    row = spark.createDataFrame([("In May, Bob ran 3.5 km. Then he saw 2 cats\u0001.",)], "t string").select(template(marked(F.col("t")))).first()[0]
    assert row == ["in", "may", "bob", "ran", "\u0002", "\u0003", "then", "he", "saw", "\u0002", "cats"] or row[:2] == ["in", "\u0001"]


def test_leaks(spark):
    other = QUESTION.replace("Alice", "Robert").replace("12", "30").replace("5 kg", "8 kg")
    clash = QUESTION.replace("named Alice", "named Robert").replace("Then Alice", "Then Martha")
    rows = [
        (1, f"Some words before. {QUESTION} And some after."),
        (2, f"First line\n{other}"),
        (3, clash),
        (4, QUESTION.upper()),
        (5, "Bread is sold each morning in many places, and flour is paid for by the kg."),
        (6, None),
        (7, ""),
        (8, " ".join(QUESTION.split()[:9])),
        (9, f"One asks: {SHORT.lower()} Nobody knows."),
        (1, f"Some words before. {QUESTION} And some after."),
        (None, QUESTION),
        (10, QUESTION.replace(" ", "  \n")),
    ]
    bench = spark.createDataFrame([(70, QUESTION, 1), (71, SHORT, 1), (72, None, 1), (73, "", 1), (70, QUESTION, 2)], "item_id long, text string, id int")
    got = {(r["id"], r["item"]): r["same"] for r in leaks(table(spark, rows), bench).collect()}
    assert got.keys() == {(1, 70), (2, 70), (4, 70), (9, 71), (None, 70), (10, 70)}
    assert got[1, 70] and not got[2, 70]


def test_items_of_many_values_are_found_anywhere(spark):
    items = ["Solve 3 x + 4 y = 10 and 5 x - 2 y = 7 for x", "3 + 4 - 5 + 6 - 7 + 8 - 9 + 10 - 11", "5 x 4 = 20", "Order: Bob, Ann, Tom, Sue, Max, Eva, Ned, Ida, Kim"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(100 * k + i, f"{'so ' * i}{t} so on") for k, t in enumerate(items) for i in range(9)]
    rows += [(900, "3 + 4 - 5 + 6 - 7 + 8 - 9 + 10 - 12"), (901, "5 x 4 = 21"), (902, "so Order: Bob, Ann, Tom, Sue, Max, Eva, Ned, Kim, Ida")]
    got = {(r["id"], r["item"]) for r in leaks(table(spark, rows), bench).collect()}
    assert got == {(i, i // 100) for i, _ in rows if i < 900}


def test_values_are_compared_where_words_agree(spark):
    words = QUESTION.split()
    asked = QUESTION.replace("when the market closes", "that Alice can spend")
    cut = " ".join(words[:31])
    rows = [(1, f"{cut} of it and so on, as far as the story of this baker goes on today."), (2, asked.replace("have left", "still have left")), (3, asked.replace("much money does", "much does")), (4, cut)]
    bench = spark.createDataFrame([(70, asked)], "item_id long, text string")
    assert {(r["id"], r["same"]) for r in leaks(table(spark, rows), bench).collect()} == {(i, True) for i, _ in rows}


def test_names_of_any_form(spark):
    asked = "Alice has 3 apples and gives 2 to her brother each day. Alice then buys 4 more pears at the market"
    quoted = "The clerk asked: \"Robert, will you carry 3 boxes?\" (Robert says that he carries 2 boxes to Rome and that Robert rests)"
    rows = [(1, asked.replace("Alice", "Bob")), (2, f"Once more. {asked.replace('Alice', 'Mary Ann')}."), (3, quoted.replace("Robert", "Anna Maria")), (4, asked.replace("day. Alice", "day. Carol"))]
    more = QUESTION.replace("Alice", "Bob").split()
    more = " ".join([*more[:15], "also", *more[15:30], "then", "exactly", *more[30:]])
    rows += [(5, more), (6, asked.lower()), (7, more.replace("Then also Bob", "Then also Carol"))]
    # another order, and the item twice with one of them whole
    rows += [(8, " ".join(asked.split()[::-1])), (9, f"{rows[3][1]}. {asked}")]
    bench = spark.createDataFrame([(70, asked), (71, quoted), (72, QUESTION)], "item_id long, text string")
    got = {(r["id"], r["item"]): r["same"] for r in leaks(table(spark, rows), bench).collect()}
    assert got == {(1, 70): False, (2, 70): False, (3, 71): False, (5, 72): False, (6, 70): True, (9, 70): True}


ITEMS = [
    "A farmer called Boris keeps 14 goats and 3 cows. Each day Boris feeds every goat 2 kg of hay. How much hay does he need for the goats in a week?",
    "The train from Lisbon leaves at 9:40 and covers 310 km in 4 hours. What is its mean speed, and when does it reach the town of Porto?",
    "Why do the leaves of many trees turn red before the winter, while those of pines stay green all year round?",
    "Which painter made the ceiling of the chapel in that old palace by the river?",
    "Mix 3 cups of flour, 2 eggs and 100 ml of milk, then wait.",
    "Name the largest moon of Saturn.",
    "12 + 7 - 3 * 4 / 2 + 9 - 1 = 16",
    "Anna, Ben, Cleo, Dan, Eva, Finn, Gus, Hal, Ina, Jon",
    "Seven sailors share twenty-six kg of rice for 12 days. Two sailors leave the ship at the next port. How long will the rice last now?",
]
SAID = {"14": "fourteen", "3": "three", "2": "zwei", "4": "quatre", "12": "twelve", "Seven": "7", "twenty-six": "26", "Two": "Five", "100": "cien"}


def spoiled(rng, item):
    """An item with words, names and numbers changed, put in or left out."""
    words = item.split(" ")
    for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
        i = rng.randrange(len(words))
        how = rng.randrange(6)
        if how == 0:
            words[i] = rng.choice(["red", "Otto", "77", "so", "Mary Ann"])
        elif how == 1:
            words.insert(i, rng.choice(["then", "Zoe", "5", "well"]))
        elif how == 2 and len(words) > 1:
            del words[i]
        elif how == 3:
            words = [w.replace("Boris", "Clara").replace("14", "19").replace("Porto", "Faro") for w in words]
        elif how == 4:
            words = words[i:] if rng.random() < 0.3 else words
        else:
            words = [SAID.get(w, w) for w in words]
    return " ".join(words)


def test_leaks_as_in_plain_python(spark):
    rng = random.Random(41)
    noise = lambda n: " ".join(rng.choice(["and", "the", "river", "Ada", "9", "goes", "over", "hills.", "Then", "we", "saw", "it,"]) for _ in range(n))
    rows = []
    for i in range(240):
        text = noise(rng.randrange(12))
        for _ in range(rng.choice([0, 1, 1, 2])):
            text += f" {spoiled(rng, rng.choice(ITEMS))} {noise(rng.randrange(9))}"
        rows.append((i, text if i % 9 else text.lower()))
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = {(r["id"], r["item"]) for r in leaks(table(spark, rows), bench).collect()}
    want = {(i, k) for i, text in rows for k, item in enumerate(ITEMS) if plain_templates.holds(text, item)}
    assert got == want and len(want) > 60
    assert len({k for _, k in want}) == len(ITEMS)


def test_numbers_in_words(spark):
    asked = "Tom has 3 apples and gives 2 kg of them to his brother each day, then he buys 4 more at the market"
    words = asked.replace("3", "three").replace("2", "two").replace("4", "four")
    other = asked.replace("3", "zwanzig").replace("2 kg", "cinco kg").replace("4", "onze")
    twice = "He takes 3 of the pears, then 5 of the plums, and at last 3 of the very ripe cherries home"
    rows = [(1, words), (2, other), (3, asked.replace("3", "twenty-three")), (4, twice.replace("3", "three"))]
    rows += [(5, twice.replace("3", "six", 1)), (6, twice.replace("3", "twenty one").replace("5", "dreiundvierzig")), (7, words.upper().replace("TOM", "Tom"))]
    bench = spark.createDataFrame([(70, asked), (71, twice)], "item_id long, text string")
    got = {(r["id"], r["item"]): r["same"] for r in leaks(table(spark, rows), bench).collect()}
    assert got == {(1, 70): True, (2, 70): False, (3, 70): False, (4, 71): True, (6, 71): False, (7, 70): True}


def test_words_and_values_go_together(spark):
    """A template has as many words as values, in both readings, wherever numbers stand."""
    texts = ["Twenty three Rivers", "We saw Twenty-One ships, twenty -one", "TWO3 two3 3two FÜNF", "Two Hundred Kings, One Mile", "so Dreiundzwanzig dreiundzwanzig  twenty     two", "In Twenty Two Mary Ann"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for names in ("inner", "every"):
        for r in rows.select("t", template(marked(F.col("t")), names).alias("w"), template_values(F.col("t"), names).alias("v")).collect():
            plain = plain_templates.read(r["t"], names)
            assert r["v"] == [v for _, v in plain] and len(r["w"]) == len(plain), r


def test_windows_of_both_readings(spark):
    """Every window of every kind, from words found once, in compiled code up to the join; and the same digest for the same words."""
    texts = ["In May, Mary Ann ran twenty-three km with Bob. Then He saw 2 cats", "then he SAW 2 cats", "Otto", "", None, "Then He saw five cats. Then He saw 2 cats"]
    kinds = [("every", 3), ("inner", 3), ("inner", 8), ("plain", 8)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, row long, text string")
    got = defaultdict(set)
    for r in text_windows(rows, kinds).collect():
        got[r["kind"], r["w"]].add((r["id"], r["place"]))
    want = defaultdict(set)
    for i, text in enumerate(texts):
        for names, width in kinds:
            words = plain_templates.plain(text or "") if names == "plain" else plain_templates.read(text or "", names)
            for place, w in plain_templates.windows(words, width, 0).items():
                want[f"{names} {width}", w].add((i, place))
    placed = lambda found: sorted((kind, sorted(places)) for (kind, _), places in found.items())
    assert placed(got) == placed(want) and any(len({i for i, _ in places}) > 1 for places in want.values())
    plan = text_windows(rows, [("every", 8), ("inner", 8)]).select("id", "row", "w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    made = re.findall(r"(\*\(\d+\) )?Generate \w+\(", plan)
    assert len(made) == 2 and all(made)


def test_a_window_that_all_items_share(spark):
    """Documents meet only the items whose rarer windows they hold."""
    start = "In the following task you are asked to find out as well as you can"
    ends = ["how high the tower of the old town hall is", "who wrote the song about the seven lost sailors", "where the small boat was seen last on the lake"]
    bench = spark.createDataFrame([(i, f"{start} {e}") for i, e in enumerate(ends)], "item_id long, text string")
    rows = [(10, f"{start} nothing"), (11, f"so {start} {ends[1]}"), (12, f"{ends[2]} so")]
    got = {(r["id"], r["item"]) for r in leaks(table(spark, rows), bench).collect()}
    assert got == {(i, k) for i, t in rows for k, e in enumerate(ends) if plain_templates.holds(t, f"{start} {e}")} and (11, 1) in got


def test_leaks_of_very_long_texts(spark):
    bench = spark.createDataFrame([(70, QUESTION)], "item_id long, text string")
    rows = [(1, "many words go by " * 30000 + QUESTION), (2, f"{QUESTION} " * 60)]
    assert {r["id"] for r in leaks(table(spark, rows), bench).collect()} == {1, 2}


def test_leaks_of_nothing(spark, nothing):
    bench = spark.createDataFrame([(70, QUESTION)], "item_id long, text string")
    assert leaks(nothing, bench).count() == 0
    assert leaks(table(spark, [(1, QUESTION)]), bench.where("false")).count() == 0


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><ul><li><a href=x>Home</a></ul></header><nav>Menu</nav><div id="cookie-notice">Cookies!</div>
<article><header><h1>My   title</h1><p class="byline">By X</p></header><p>First &amp; foremost.<br>Next&nbsp;line</p><div class="ad">Buy</div>
<p>Short.<p><b>Open bold <i>text</p><ul><li>one<li>two</ul><form><input>Mail</form><script>if (a<b) x("</p>")</script></article>
<aside>Side</aside><section id="comments"><article><p>A long comment that a reader left below the text.</p></article></section><footer>(c)</footer></body>"""


def test_article():
    assert main_text(PAGE).split("\n\n") == ["My title", "First & foremost. Next line", "Short.", "Open bold text", "one", "two"]


def test_page_without_article():
    page = """<div class=wrap><div class="menu"><a href=1>A</a><a href=2>B</a></div><div><ul><li><a href=3>Links here</a><li><a href=4>and there</a></ul></div>
    <div id="content"><h2>Heading</h2><p>Some long text that runs on.</p><p>More of it that runs on too.</p><p>End.</p></div><div class="sidebar"><p>Popular</p></div></div>"""
    assert main_text(page) == "Heading\n\nSome long text that runs on.\n\nMore of it that runs on too.\n\nEnd."


def test_layout_words_are_no_marks():
    page = """<body><div class="page with-sidebar"><main><article><div class="entry-header"><h1 class="page-header">Title</h1></div><p>Text of the article, which is long enough.</p>
    <div class="related-posts"><p>Another one</p></div></article><section><h3>More</h3><article><p>Card</p></article></section></main></div></body>"""
    assert main_text(page) == "Title\n\nText of the article, which is long enough."
    assert main_text('<div id="sidebar-layout"><article><p>All of it.</p></article></div>') == "All of it."
    assert main_text('<div class="ad">Buy</div><article><p class="notice">Closed</p></article><footer>f</footer>') == ""


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>only", "only"),
        ("plain &lt;text", "plain <text"),
        ("<script>never closed", ""),
        ("<nav>menu</nav>", ""),
        ("<article></article>", ""),
        ("<!-- open <p>x", ""),
        ("<article><p title='a > b'>x</p></article>", "x"),
        ("<article><p title=\"open>x</p></article>", "x"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</article>", "yes"),
        ("<article>" + "<div>" * 300 + "deep" + "</div>" * 300, "deep"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_core_is_the_largest_stretch():
    assert core([0, 0, 5, 0, 0, 0, 0, 40, 50, 0, 60, 0, 0, 0, 9]) == (7, 11)
    assert core([]) == (0, 0)
    assert [line.text for line in Page("<nav>a</nav><p>b").lines] == ["", "b"]


def test_the_core_decides_between_elements():
    """The text is in a division, while articles are cards of other stories."""
    text = "<p>This is the story itself, told in some sentences that go on.</p>" * 6
    cards = "".join(f"<article><h3>Card {i}</h3><p>Teaser</p></article>" for i in range(4))
    assert main_text(f"<body><div>{cards}</div><nav>m</nav><nav>m</nav><nav>m</nav><div>{text}</div></body>").split("\n\n") == ["This is the story itself, told in some sentences that go on."] * 6
    # a headline and a lead beside an article are kept with it
    lead = "<h2>A headline</h2><p>And a lead that says in one sentence what the story is.</p>"
    assert main_text(f"<main>{lead}<article>{text}</article></main>").startswith("A headline\n\nAnd a lead")
    assert main_text(f"<body>{lead}<article>{text}</article></body>").startswith("A headline\n\nAnd a lead")


PARAGRAPHS = [f"The mayor said on Monday that the bridge would open again before the winter comes, number {i} of the things said." for i in range(5)]
RUNNING = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        "<body><form action=x><div id=content>{}</div><input name=q><button>Go</button></form></body>",
        '<body><a name="top"><div>{}</div></body>',
        '<body><div class="elementor-element elementor-widget elementor-widget-text">{}</div></body>',
        '<body><div class="side-by-side">{}</div></body>',
        '<body><div class="social-news">{}</div></body>',
        '<body><div class="elementor-widget"><form><div class="side-by-side">{}</div></form></div></body>',
        "<body><svg><path d=x><div>{}</div></body>",
        "<body><form><article>{}</article></form><nav>menu</nav></body>",
    ],
)
def test_weak_marks_do_not_hide_the_text(page):
    assert main_text(page.format(RUNNING)) == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("mark", ["comments", "comment-list", "sidebar", "ad", "cookie-banner", "site-footer", "related-posts"])
def test_strong_marks_stay(mark):
    """However much there is of it."""
    assert main_text(f'<body><p>Short article.</p><div class="{mark}">{RUNNING}</div></body>') == "Short article."
    assert main_text(f'<body><div class="{mark}">{RUNNING}</div></body>') == ""


def test_standfirst_stays():
    page = '<article><header><h1>T</h1><p>What it is about.</p><p class="byline">By X</p><time>today</time><ul><li>Share</ul></header><p>Text of it.</p></article>'
    assert main_text(page) == "T\n\nWhat it is about.\n\nText of it."


def plain_core(lengths, window=3, surge=80):
    """Surge and dive, every stretch tried: the one with the most text, the first of equals."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    least = max(1, min(surge, max(sums, default=0)))
    found = (0, 0, 0)
    for i in range(len(sums)):
        for j in range(i + 1, len(sums) + 1):
            if all(s >= least for s in sums[i:j]) and (i == 0 or sums[i - 1] < least) and (j == len(sums) or sums[j] < least):
                stop = min(len(lengths), j + window - 1)
                if sum(lengths[i:stop]) > found[0]:
                    found = (sum(lengths[i:stop]), i, stop)
    some = [i for i in range(found[1], found[2]) if lengths[i]]
    return (some[0], some[-1] + 1) if some else (0, 0)


def test_core_against_plain():
    rng = random.Random(3)
    for _ in range(400):
        lengths = [rng.choice([0, 0, 3, 20, 40, 90]) for _ in range(rng.randrange(30))]
        got = core(lengths)
        assert (got if got[0] < got[1] else (0, 0)) == plain_core(lengths)


def test_without_a_core_pages_are_wrong(monkeypatch):
    """Generated pages without an article element, with teasers and short blocks around the text: the core finds it."""
    from manyview.llm import html_text

    rng = random.Random(1)
    pages = []
    for _ in range(40):
        text = [f"Sentence {i} of a story that goes on and on, with {rng.randrange(100)} things in it to be told." for i in range(rng.randrange(4, 9))]
        short = lambda k: "".join(f"<div><p>Card {rng.randrange(99)}</p></div><div></div><hr>" for _ in range(k))
        pages.append((f"<body><div>{short(rng.randrange(60, 90))}</div><hr><hr><div>{''.join(f'<p>{t}</p>' for t in text)}</div><hr><hr><div>{short(rng.randrange(60, 90))}</div></body>", "\n\n".join(text)))
    assert all(main_text(page) == text for page, text in pages)
    monkeypatch.setattr(html_text, "core", lambda lengths: (0, len(lengths)))
    assert sum(main_text(page) == text for page, text in pages) < 20


def test_links_within_the_text_stay():
    page = "<article><p>Long text that runs on for a while, with no link in it at all.</p><p><a href=x>A link of its own</a></p></article>"
    assert main_text(page).endswith("A link of its own")


@pytest.mark.parametrize("page", ["<div>x " * 20000, "<b>x" * 9000 + "<div>y</div>" * 9000, "<title>" * 20000, "<!" * 50000, "<article>" * 9000 + "text", "<script>" + "</script " * 20000, "<a href=x>y" * 30000])
def test_deep_pages_take_little_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 5


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y"), (3, "v", "", "z")], "page_id long, url string, html string, text string")
    got = extract_text(pages, ["page_id", "url", "text"]).collect()
    assert sorted((r["page_id"], r["__html_chars"]) for r in got) == [(1, len(main_text(PAGE))), (2, 0), (2, 0), (3, 0)]
    assert extract_text(pages.where("false"), ["page_id"]).count() == 0


# --- licenses ---


def test_rules_are_ordered():
    found = rules()
    assert len(found) > 200 and [r.priority for r in found] == sorted((r.priority for r in found), reverse=True)


def test_licenses(spark, corpus):
    texts = [
        "Released under the MIT License.",
        "MIT license MIT-license; mit, license! The Apache\nLicense and the GNU General Public License version 3",
        "submit license; general public licenses",
        "Copyright 2020. SPDX-License-Identifier: Apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "İ mit license é",
        "nothing here",
        None,
        "",
        "mit license " * 300,
    ]
    rows = [*enumerate(texts), *[(1000 + k, t) for k, (_, t) in enumerate(corpus[:30])]]
    got = {r["doc_id"]: r for r in scan_licenses(table(spark, rows), ["doc_id", "words"]).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["__lic_words"], r["__lic_base"], r["__lic_first"], r["__lic_last"], r["__lic_base_labels"]) == plain.phrases(t), t
        assert set(filter(None, r["__lic_base_labels"].split(","))) <= set(r["__lic_labels"].split(",")), t
        assert 0 <= r["__lic_score"] <= 1 and (r["__lic_score"] > 0) == bool(r["__lic_labels"])
    assert got[0]["__lic_labels"] == "mit" and got[4]["__lic_labels"] == "mit"
    assert "apache-2.0" in got[3]["__lic_labels"].split(",") and got[3]["__lic_score"] == 1.0
    # what lies in a match of higher priority is not told twice
    spans = [(s["start"], s["stop"]) for s in got[0]["__lic_spans"]]
    assert len(spans) == 1
    assert scan_licenses(table(spark, []), ["doc_id"]).count() == 0


def held_by(words):
    """Labels of the detections that hold, by trying all rules on all words."""
    said, found = f" {' '.join(words)} ", []
    for r in rules():
        for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", said):
            found.append((m.start(), m.end(), r.priority, r.label))
    inside = lambda s, o: o[0] <= s[0] and o[1] >= s[1] and (o[2] > s[2] or (o[2] == s[2] and o[1] - o[0] > s[1] - s[0]))
    # what is inside something that is itself suppressed is inside what suppresses that
    return sorted({s[3] for s in found if not any(inside(s, o) for o in found)})


def test_licenses_as_in_plain_python(spark):
    rng = random.Random(3)
    pieces = """mit license|licensed under the mit license|apache license version 2 0|the gnu general public license v3|spdx license identifier bsd 3 clause|all rights reserved
    copyright 2019|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    neither the name of the group nor the names of its contributors may be used to endorse or promote products|https www apache org licenses license 2 0|is in the public domain
    this work is licensed under a creative commons attribution share alike 4 0 international license|you may not reverse engineer decompile or disassemble|some words
    released under the terms of the gnu general public license|dual licensed under the|proprietary license|cc0 1 0|the software shall be used for good not evil""".replace("\n", "|").split("|")
    rows = [(i, " ".join(rng.choice(pieces).strip() for _ in range(rng.choice([1, 2, 5, 12])))) for i in range(150)]
    for r in scan_licenses(table(spark, rows), ["doc_id", "text"]).collect():
        words = r["text"].split()
        want = {*held_by(words), *filter(None, r["__lic_base_labels"].split(","))}
        assert r["__lic_labels"] == ",".join(sorted(want)), r["text"]


def test_long_texts_are_scanned_in_blocks(spark):
    """A mention is found wherever it stands, also across the edges of blocks, and holds only once."""
    notice = "licensed under the apache license version 2 0"
    rows = [(n, f"{'word ' * n}{notice} {'word ' * 700}") for n in (0, 500, 505, 508, 511, 512, 513, 1020, 5000)]
    for r in scan_licenses(table(spark, rows), ["doc_id"]).collect():
        n = r["doc_id"]
        assert [(s["start"], s["stop"], s["label"]) for s in r["__lic_spans"]] == [(n, n + 8, "apache-2.0")] and r["__lic_labels"] == "apache,apache-2.0"
    many = scan_licenses(table(spark, [(1, "mit license " * 20000)]), ["doc_id"]).first()
    assert many["__lic_base"] == 20000 and many["__lic_last"] == 39998


def test_rules_are_bounded_and_gated():
    """No pattern repeats without end, none is longer than a block's margin, and each needs a word of the gate."""
    for r in rules():
        words = re.sub(r"\(\?:\\S\+ \)\{1,(\d+)\}\?", lambda m: "x " * int(m[1]), r.pattern).replace(r"\S+", "x")
        assert "*" not in words and "+" not in words and len(words.split()) <= MOST_WORDS, r
        bare = r.pattern
        while (less := re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{[^}]*\}\??)?", " ", bare)) != bare:
            bare = less
        choices = re.findall(r"[a-z]+", r.pattern) if not bare.strip() or bare.strip() == "org" else [bare]
        assert any(g in c for c in choices for g in GATE), r
    assert any(g in "mit license" for g in GATE) and any(g in "general public license" for g in GATE)


def shortest(parsed):
    """Of all that a pattern matches, the shortest text for each choice of alternatives."""
    out = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            some = [chr(value)]
        elif kind == "IN":
            some = [next((chr(v if str(k) == "LITERAL" else v[0]) for k, v in value if str(k) in ("LITERAL", "RANGE")), "1")]
        elif kind == "BRANCH":
            some = [x for way in value[1] for x in shortest(way)]
        elif kind == "SUBPATTERN":
            some = shortest(value[3])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [x * value[0] for x in shortest(value[2])] if value[0] else [""]
        else:
            some = [""]
        out = [a + b for a in out for b in dict.fromkeys(some)][:500]
    return out


def test_no_alternative_lacks_its_keyword():
    for r in rules():
        for text in shortest(re._parser.parse(r.pattern)):
            assert r.keyword in text, (r, text)


def test_responsible_ai(spark):
    out = scan_licenses(spark.createDataFrame([(1, "Released under the Responsible AI License.")], "doc_id long, text string"), ["doc_id"]).first()
    assert out["__lic_labels"] == "openrail"


# --- mixing ---


def test_ties_are_ordered_by_text(spark):
    """Rows of one id and size get the same copies however they are stored."""
    rows = [(7, f"w{i} x y", "a") for i in range(40)] + [(i, "one two", "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = ({r["text"]: r["__mix_copies"] for r in mix_sources(docs.repartition(n), ["text", "source"]).where("source = 'a'").collect()} for n in (1, 9))
    assert one == two and len(one) == 40 and len(set(one.values())) > 1


def test_sources_of_some_documents_come_near_their_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["x"] * int(rng.lognormvariate(5, 1.2) + 1)), f"s{i % 6}") for i in range(600)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"])
    for r in out.groupBy("source").agg(F.sum(F.expr("__mix_copies * __mix_size")).alias("taken"), F.max("__mix_target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.02


def test_mixing(documents, corpus):
    out = mix_sources(documents, ["doc_id", "source", "text", "words"]).collect()
    again = mix_sources(documents.repartition(7), ["doc_id", "source", "text", "words"]).collect()
    assert Counter(out) == Counter(again)
    sizes = defaultdict(int)
    for r in out:
        assert r["__mix_size"] == len(plain.words(r["text"])) and 0 <= r["__mix_copies"] <= 3
        sizes[r["source"]] += r["__mix_size"]
    goal = plain.targets(sizes)
    largest = max(r["__mix_size"] for r in out)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert {round(r["__mix_target"], 6) for r in mine} == {round(goal[s], 6)} and {r["__mix_total"] for r in mine} == {sizes[s]}
        assert abs(sum(r["__mix_copies"] * r["__mix_size"] for r in mine) - goal[s]) <= 2 * largest


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 400}, {"a": 5}, {"a": 1, "b": 2, "c": 3, "d": 90, None: 4}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    rows = [(i, " ".join(["x"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"]).collect()
    assert {r["source"]: round(r["__mix_target"], 6) for r in got} == {s: round(t, 6) for s, t in plain.targets(sizes).items()}


def test_taken_is_near_target(spark):
    """Within one part in fifty for sources of some thousand documents."""
    rng = random.Random(1)
    rows = [(i, " ".join(["x"] * rng.choice([3, 40, 300])), f"s{min(3, i % 9)}") for i in range(9000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"])
    for r in out.groupBy("source").agg(F.sum(F.expr("__mix_copies * __mix_size")).alias("taken"), F.max("__mix_target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.02


def test_inclusion_is_proportional(spark):
    """Over many offsets a document comes as often as its expected copies say; what it is does not depend on the draw."""
    rng = random.Random(2)
    rows = [(i, " ".join(["x"] * rng.choice([1, 2, 3, 5])), f"s{i % 2}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).persist()
    total = Counter()
    for seed in range(12):
        for r in mix_sources(docs, ["doc_id"], seed=f"seed {seed}").collect():
            total[r["doc_id"]] += r["__mix_copies"]
            rate = r["__mix_target"] / r["__mix_total"]
            assert r["__mix_copies"] in (int(rate), int(rate) + 1)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1")}
    goal = plain.targets(sizes)
    for s in sizes:
        mean = sum(total[i] for i, _, x in rows if x == s) / 400 / 12
        assert abs(mean - goal[s] / sizes[s]) < 0.01


def test_long_documents_leave_room(spark):
    """A text longer than its source's target is left out where shorter ones can make up for it; texts without words come as the source does."""
    rows = [(0, "x " * 20000, "a")] + [(i, "y " * 100, "a") for i in range(1, 201)] + [(1000 + i, " ", "a") for i in range(300)] + [(5000, "z " * 10000, "b")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"], weights=(1, 3)).where("source = 'a'").collect()
    target = out[0]["__mix_target"]
    assert target == 20000.0 and abs(sum(r["__mix_copies"] * r["__mix_size"] for r in out) - target) <= 200
    light = [r["__mix_copies"] for r in out if not r["__mix_size"]]
    assert 0.4 < sum(light) / len(light) < 0.6


def test_mixing_nothing(nothing):
    assert mix_sources(nothing, ["doc_id"]).count() == 0


# --- search ---


def test_top_k(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 8)).astype("float32")
    vectors[200:700] = vectors[200]
    rows = [(int(i) * 7, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(350_000, None, 1), (350_050, [1.0, None], 1), (350_100, [float("nan")] * 8, 1), (350_150, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (-50, [0.5] * 8, 1)]
    rows += [rows[0], (10**15, [0.25] * 8, 1), (10**15 + 50, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, np.floor(256 * np.array(v or [0] * 8, "float32").astype(float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    m = np.stack([v for _, v in whole])
    want = Counter()
    for q, (i, v) in enumerate(whole):
        if i % 50 == 0:
            best = sorted((-s, j) for r, ((j, _), s) in enumerate(zip(whole, m @ v, strict=True)) if r != q)[:5]
            want.update((i, r, j, int(-s)) for r, (s, j) in enumerate(best, 1))
    got = registry.op5_topk_search(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_top_k_of_few(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(few.where("false")).count() == 0
    assert top_k(few.where("vec_id = 0")).count() == 0
    # rows that share an id are rows of their own; two of them are queries here
    same = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [2.0]), (1, [3.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["id"]) for r in top_k(same).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert top_k(few.union(few)).where("rank = 1").count() == 2
    # scores beyond what floats hold exactly
    odd = [(0, [1.0, 2.0**40]), (1, [3.0, 2.0**30]), (2, [2.0, 2.0**30])]
    got = top_k(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(i, min(2**63 - 1, int(256 * v[0]) * 256 + int(256 * v[1]) * 2**48)) for i, v in odd[1:]]
    huge = spark.createDataFrame([(0, [1.0, 1e300]), (1, [2.0, 0.0]), (2, [3e8, -1.0])], "vec_id long, embedding array<double>")
    assert [r["id"] for r in top_k(huge).orderBy("rank").collect()][0] == 1


def test_blocks_are_pruned():
    """Of rows in a few tight groups, a query's own group is scored and little else."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 32)) * 200
    v = np.floor(np.repeat(centres, 128, 0) + rng.normal(size=(2048, 32)) * 4)
    rows = pa.table({"uid": np.arange(2048), "id": np.arange(2048), "code": [f"{i // 128:03d}" for i in range(2048)], "v": pa.array(v.tolist())})
    shard = Shard(rows, 32, 128)
    ids, scores = shard.search(np.arange(64), v[:64], np.full(64, -np.inf), 5)
    exact = v[:64] @ v.T
    exact[np.arange(64), np.arange(64)] = -np.inf
    assert (scores == -np.sort(-exact, 1)[:, :5]).all() and shard.visited < 0.2 * shard.blocks
    # a floor spares what a query has found elsewhere
    shard.visited = shard.blocks = 0
    ids, scores = shard.search(np.arange(64), v[:64], np.full(64, 1e12), 5)
    assert shard.visited == 0 and not np.isfinite(scores).any()
