"""Decontamination in plain Python: every document against every item, word by word."""

import math

import regex

from manyview.llm.decontamination import ONES, SPELLED_AS, TENS, UNITS

COUNTED = "|".join(sorted({w.capitalize() for w in [*SPELLED_AS, *ONES]}, key=len, reverse=True))
CAPITAL = rf"(?!(?:{COUNTED})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{Ll}}\p{{M}}]++(?![\p{{L}}\p{{M}}])"
RUN = rf"{CAPITAL}(?:\s{{1,4}}{CAPITAL})*+"
NAMES = {"inner": rf"(?<=[\p{{L}}\p{{N}},;]\s{{1,4}}){RUN}", "every": rf"(?<![\p{{L}}\p{{M}}]){RUN}"}
NUMBER = r"\p{N}+(?:[.,:]\p{N}+)*"
UNIT = regex.compile(rf"(?:{UNITS})\Z")


def read(text, names):
    """(word, value) for each word of the template; placeholders are None and the kind."""
    scan = regex.compile(rf"(?P<name>{NAMES[names]})|(?P<number>{NUMBER})|(?P<word>[\p{{L}}\p{{M}}]+)")
    out, last = [], None
    for m in scan.finditer(text):
        value = regex.sub(r"\s+", " ", m.group().lower())
        kind = m.lastgroup
        between = text[last.end() : m.start()] if last else ""
        before = last.group().lower() if last and last.lastgroup == "word" else ""
        if kind == "word" and value in ONES and before in TENS and regex.fullmatch(r"-|\s{1,4}", between):
            out[-1] = (out[-1][0], str(SPELLED_AS[before] + ONES[value]))
            last = m
            continue
        if kind == "word" and value in SPELLED_AS:
            kind, value = "number", str(SPELLED_AS[value])
        elif kind == "word" and out and out[-1][0] == (None, "number") and UNIT.match(value) and regex.fullmatch(r"\s{0,4}", between):
            kind = "unit"
        out.append(((None, kind) if kind != "word" else (value, kind), value))
        last = m
    return out


def plain(text):
    return [((w, "word"), w) for w in regex.findall(rf"{NUMBER}|[\p{{L}}\p{{M}}]+", text.lower())]


def windows(words, width, literal):
    every = [tuple(w for w, _ in words[i : i + width]) for i in range(len(words) - width + 1)]
    return {i: w for i, w in enumerate(every) if sum(k == "word" for _, k in w) >= literal}


def chains(hits, width, reach, drift):
    """Structs of the longest chain that ends in each hit and in no longer one."""
    states = []
    for place, at in sorted(hits):
        near = [
            s
            for s in states
            if s["place"] >= place - reach and s["at"] < at and s["place"] < place and abs(place - at - s["place"] + s["at"]) <= drift
        ]
        best = max(near, key=lambda s: (s["n"], -abs(place - at - s["place"] + s["at"]), s["at"], s["place"]), default=None)
        new = {"place": place, "at": at, "n": 1, "pairs": {(at + i, place + i) for i in range(width)}, "ends": True}
        if best:
            done = max(a for a, _ in best["pairs"])
            new["n"] += best["n"]
            new["pairs"] = best["pairs"] | {(at + i, place + i) for i in range(width) if at + i > done}
            best["ends"] = False
        states.append(new)
    return [s for s in states if s["ends"]]


def clash(pairs, asked, found):
    said = {}
    for a, b in pairs:
        if asked[a][0][0] is not None:
            continue
        x, y = asked[a][1].split(" "), found[b][1].split(" ")
        for p, q in zip(x, y, strict=True) if len(x) == len(y) else [(x[-1], y[-1])]:
            if said.setdefault(p, q) != q:
                return True
    return False


def holds(text, item, width=8, literal=5, cover=0.5, drift=8):
    """Whether a document holds an item."""
    short = len(read(item, "inner")) < width + 3
    size, least = (3, 2) if short else (width, literal)
    tries, sure = [], False
    for names in NAMES:
        asked = read(item, names)
        wanted = windows(asked, size, least)
        sure = sure or any(i > 0 or names == "every" for i in wanted)
        tries.append((asked, read(text, names), size, wanted, cover, drift))
    if not sure:
        asked = plain(item)
        size = width if len(asked) >= width else 3
        tries.append((asked, plain(text), size, windows(asked, size, 0), 1.0, 0))
    for asked, found, size, wanted, share, turn in tries:
        if not wanted:
            continue
        enough = math.ceil(len(wanted) * share)
        here = windows(found, size, 0)
        hits = {(j, i) for j, w in here.items() for i, v in wanted.items() if v == w}
        for c in chains(hits, size, len(asked) + turn, turn):
            if c["n"] >= enough and not clash(c["pairs"], asked, found):
                return True
    return False
