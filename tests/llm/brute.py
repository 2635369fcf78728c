"""Plain restatements of the contracts, for tests only."""

import functools
import hashlib
import math
import operator
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def lines(rows, min_docs=10):
    """[(id, text)] -> {row number: (n_lines, n_dropped, sha)}"""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and count[key(x)] >= min_docs)]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def quality(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def edited(rows):
    """[(id, text)] with distinct ids -> {id: edited text}"""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        m = len(t) // 4
        out[i] = t[: len(t) - m] + rows[(k + 1) % len(rows)][1][:m]
    return out


def shingles(t, size=5):
    w = [lower(x) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def linked_groups(rows, size=5, percent=80):
    """[(id, text)] -> [(id, set size, least id reachable)] by comparing all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    seen = set()
    for held in at.values():
        for k, i in enumerate(held):
            for j in held[:k]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        above[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def in_turns(rows):
    """[(conv_id, turn, role, text)] -> {conv_id: its rows in order}"""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        out.setdefault(r[0], []).append(r)
    return out


def trie(rows):
    """[(conv_id, turn, role, text)] -> rows of the trie's nodes"""
    convs = {c: [(role, text) for _, _, role, text in rs] for c, rs in in_turns([(c, t, role or "", text or "") for c, t, role, text in rows if c is not None]).items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, ends, below = {}, {}, {}
    for c in sorted(rebuilt):
        turns = tuple(rebuilt[c])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                below.setdefault(turns[: d - 1], set()).add(turns[:d])
        ends.setdefault(turns, []).append(c)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        kids = below.get(n, ())
        leaves[n] = sum(leaves[k] for k in kids) if kids else 1
        saved[n] = (len(members[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(saved[k] for k in kids)
    return [(members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(below.get(n, ())), leaves[n], saved[n], sha(",".join(map(str, ends.get(n, []))))) for n in members]


def damaged(rows):
    """[(conv_id, turn, role, text)] -> the rows after damage"""
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            out += [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def repairs(rows):
    """[(conv_id, turn, role, text)] before damage -> one row for each conversation, by a search over all edits"""
    convs, out = in_turns(damaged(rows)), []
    grammar = re.compile("(s?(ua)+)?")
    lead = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow what
    for c in {r[0] for r in rows}:
        own, seen, faults = convs.get(c, []), set(), []
        for _, _, role, text in own:
            faults.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if text.strip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(k, last, more=2):
            """Cost, letters and turns of the cheapest way on from row k behind a turn of this initial."""
            ways = []
            if k == len(own):
                if last in ("", "a"):
                    ways.append((0, "", ()))
            else:
                _, _, role, text = own[k]
                add = lambda cost, letter, turn, rest: ways.append((cost + rest[0], letter + rest[1], turn + rest[2]))
                add(4, "D", (), best(k + 1, last))
                if faults[k] in ("", "truncated"):
                    extra = 3 * (faults[k] == "truncated")
                    if role[:1] and role[:1] in lead[last]:
                        add(extra, "K", (f"{role}:{text}",), best(k + 1, role[0]))
                    for r in ("user", "assistant"):
                        if r[0] in lead[last]:
                            add(3 + extra, "R", (f"{r}:{text}",), best(k + 1, r[0]))
            if more:
                for r in ("user", "assistant"):
                    if r[0] in lead[last]:
                        rest = best(k, r[0], more - 1)
                        ways.append((3 + rest[0], "I" + rest[1], (f"{r}:", *rest[2])))
            return min(ways, default=(1 << 40, "", ()))

        cost, audit, turns = best(0, "")
        assert grammar.fullmatch("".join(t[0] for t in turns))
        n = [t for _, t, _, _ in own if t is not None]
        gaps = max(n) - min(n) + 1 - len(set(n)) if n else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(turns))))
    return out


def near_vectors(rows, least=0.95):
    """[(vec_id, vector)] -> [(vec_id, n_links, component_id, kept)] by comparing all pairs"""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append([x / math.hypot(*v) for x in v] if ok else None)
    links, group = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a and b and len(a) == len(b) and sum(map(operator.mul, a, b)) >= least:
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    name = {}
    for g, (i, _) in zip(group, rows):
        name[g] = i if name.get(g) is None else name[g] if i is None else min(i, name[g])
    return [(i, links[k], name[group[k]], i == name[group[k]]) for k, (i, _) in enumerate(rows)]
