"""The contracts on conversations in plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    """conv_id -> [(role, text)] by turn, null first, ties by a digest."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        out[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def trie(rows):
    """Rows of the trie as a set of tuples."""
    own = ordered([r for r in rows if r[0] is not None])
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        cost = (len(who) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += cost
    return {
        (min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(kids[n]) if n in kids else 0, leaves[n], saved[n], sha(",".join(map(str, sorted(ends.get(n, []))))))
        for n, who in members.items()
    }


def damaged(rows):
    """(conv_id, turn, role, text) after the planted faults."""
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def repair(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one conversation: edits looked for
    from the last turn to the first, audits as whole texts."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).digest()))
    turns = [(t, r or "", x or "") for _, t, r, x in turns]
    seen, faults = set(), []
    for _, role, text in turns:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    # what may follow each symbol: nothing yet, after s, after u, after a
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    nothing = (10**9, "", [])

    def with_inserts(best):
        """The best from each symbol, turns put in first."""
        out = dict(best)
        for _ in range(3):
            for s in follow:
                for c, after in follow[s].items():
                    if c in names:
                        cost, audit, lines = out[after]
                        out[s] = min(out[s], (cost + 5, "I" + audit, [f"{names[c]}:", *lines]))
        return out

    best = with_inserts({0: (0, "", []), 1: nothing, 2: nothing, 3: (0, "", [])})
    for (_, role, text), fault in zip(reversed(turns), reversed(faults), strict=True):
        new = {}
        for s in follow:
            cost, audit, lines = best[s]
            ways = [(cost + 2, "D" + audit, lines)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for c, after in follow[s].items():
                    cost, audit, lines = best[after]
                    if role[:1] == c:
                        ways.append((cost + extra, "K" + audit, [f"{role}:{text}", *lines]))
                    elif c in names:
                        ways.append((cost + extra + 1, "R" + audit, [f"{names[c]}:{text}", *lines]))
            new[s] = min(ways)
        best = with_inserts(new)
    cost, audit, lines = best[0]
    some = [t for t, _, _ in turns if t is not None]
    gaps = max(some) - min(some) + 1 - len(set(some)) if some else 0
    first = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))), lines


def repairs(rows, ids):
    """conv_id -> its report."""
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    return {i: repair(of.get(i, [])) for i in ids}
